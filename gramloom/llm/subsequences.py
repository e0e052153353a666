"""Frequent ordered patterns with gaps over many documents, by sequence decision diagrams.

A run's documents are cut into chunks of bounded size (one for most runs, many for a run that owns a third
of all rows). A chunk is compressed into a shared, weighted, directed acyclic graph: the occurrences of a token whose continuations
agree become one node, from the last level back to the first; a node weighs as many documents as it stands in. Patterns are grown by
pushing each prefix token onto the diagrams of its continuations, and what a shared node yields is worked out once.

Only tokens that can be frequent at all enter: the number of times their blocks open documents is an upper bound of
their support. A run of one chunk is mined at its own threshold. A run of several is mined at the same share of each chunk, which loses
nothing (a pattern frequent in the whole is frequent in some chunk), and the candidates are then counted in all of its chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.operators import postings
from gramloom.tables import cut

#: Entries of occurrence lists in a chunk.
CHUNK = 400_000
#: Rows of (run, token) up to which the token table is broadcast (about 10 MB); beyond, the join is shuffled.
BROADCAST_ROWS = 200_000

_FOUND = pa.schema([("run_id", pa.int64()), ("chunk", pa.int32()), ("codes", pa.list_(pa.int32())), ("support", pa.int64())])
_POS = 24


def _ids(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and inverse of the distinct rows of several non-negative integer columns."""
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        _, key = np.unique(key, return_inverse=True)
        key = key * (int(c.max()) + 1 if len(c) else 1) + c
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    return first, inverse


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of consecutive groups of these sizes."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


class Diagram:
    """The shared diagram of a chunk: sorted entries, their successors, and nodes for each depth."""

    def __init__(self, packed: np.ndarray, token: np.ndarray, gap: int) -> None:
        packed, first = np.unique(packed, return_index=True)
        self.gap, self.packed, self.token = gap, packed, token[first].astype(np.int64)

    def keep(self, wanted: np.ndarray) -> None:
        """Only the entries of these tokens (a mask by token number) stay."""
        own = wanted[self.token]
        self.packed, self.token = self.packed[own], self.token[own]

    def link(self) -> None:
        """Successors: entries of the same document at most ``gap`` positions on."""
        n, doc = len(self.packed), self.packed >> _POS
        self.next = np.full((n, self.gap), -1, np.int64)
        for e in range(1, min(self.gap, n - 1) + 1):
            near = (doc[e:] == doc[:-e]) & (self.packed[e:] - self.packed[:-e] <= self.gap)
            self.next[:-e, e - 1] = np.where(near, np.arange(e, n), -1)
        self.doc = np.unique(doc, return_inverse=True)[1] if n else doc

    def supports(self, group: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
        """Distinct documents per group number below ``size``."""
        if not len(group):
            return np.zeros(size, np.int64)
        width = int(doc.max()) + 1
        return np.bincount(np.unique(group * width + doc) // width, minlength=size)

    def share(self, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges entries with equal token and equal nodes below: the node of each entry, each node's token and its distinct children."""
        children = np.sort(np.where(self.next >= 0, below[self.next], -1), axis=1)[:, ::-1]
        for e in range(1, self.gap):
            children[:, e] = np.where((children[:, e] == children[:, :e].T).any(axis=0), -1, children[:, e])
        first, node = _ids(self.token, *(children[:, e] + 1 for e in range(self.gap)))
        return node, self.token[first], children[first]


def mine(packed: np.ndarray, token: np.ndarray, vocabulary: int, threshold: float, gap: int, longest: int, shortest: int, only: list[list[int]] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(patterns, supports) for each length from ``shortest`` to ``longest`` of the patterns in at least ``threshold`` documents.

    ``packed`` is document << 24 | position. With ``only``, exactly these patterns (of any threshold) are counted instead.
    """
    d = Diagram(packed, token, gap)
    if only is not None:
        items, pairs = np.zeros(vocabulary, bool), set()
        for p in only:
            items[p] = True
            pairs |= set(zip(p[:-1], p[1:], strict=True))
    else:
        items = d.supports(d.token, np.unique(d.packed >> _POS, return_inverse=True)[1], vocabulary) >= threshold
    d.keep(items)
    d.link()
    if not len(d.packed):
        return
    # edges whose two tokens are no frequent pair can't be part of a frequent pattern
    at, e = np.nonzero(d.next >= 0)
    code = d.token[at] * vocabulary + d.token[d.next[at, e]]
    known, inverse = np.unique(code, return_inverse=True)
    if only is not None:
        good = np.array([divmod(int(c), vocabulary) in pairs for c in known], bool)
    else:
        good = d.supports(inverse, d.doc[at], len(known)) >= threshold
    if len(known):
        drop = ~good[inverse]
        d.next[at[drop], e[drop]] = -1
    suffix, wanted = ({}, set()) if only is None else ({n: {tuple(p[-n:]) for p in only if len(p) >= n} for n in range(1, longest + 1)}, {tuple(p) for p in only})
    # what a node yields, as runs of (node, pattern number); at depth 1 its own token
    node = np.unique(d.token, return_inverse=True)[1]
    tokens = np.unique(d.token)
    start, size, pattern = np.arange(len(tokens)), np.ones(len(tokens), np.int64), np.arange(len(tokens))
    table = tokens[:, None]
    for length in range(2, longest + 1):
        node_up, token_up, children = d.share(node)
        at, e = np.nonzero(children >= 0)
        child = children[at, e]
        n = size[child]
        owner, below = np.repeat(at, n), pattern[np.repeat(start[child], n) + _spread(n)]
        head = token_up[owner]
        first, number = _ids(head, below) if len(head) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        table = np.column_stack([head[first], table[below[first]]]) if len(first) else np.zeros((0, length), np.int64)
        # a node yields a pattern once
        width = len(first) or 1
        both = np.unique(owner * width + number)
        owner, number = both // width, both % width
        # documents through the nodes they stand in
        pair = np.unique(node_up * (int(d.doc.max()) + 1) + d.doc)
        pair_node, pair_doc = pair // (int(d.doc.max()) + 1), pair % (int(d.doc.max()) + 1)
        size = np.bincount(owner, minlength=len(token_up))
        start = np.cumsum(size) - size
        n = size[pair_node]
        support = d.supports(number[np.repeat(start[pair_node], n) + _spread(n)], np.repeat(pair_doc, n), len(first))
        if only is None:
            frequent = support >= threshold
        else:
            frequent = np.array([tuple(r) in suffix.get(length, ()) for r in table.tolist()], bool)
        # only frequent ones are pushed further
        stay = frequent[number] if len(number) else np.zeros(0, bool)
        owner, number = owner[stay], number[stay]
        order = np.cumsum(frequent) - 1
        pattern, table, support = order[number] if len(number) else number, table[frequent], support[frequent]
        size = np.bincount(owner, minlength=len(token_up))
        start, node = np.cumsum(size) - size, node_up
        if length >= shortest and len(table):
            if only is None:
                yield table, support
            else:
                own = np.array([tuple(r) in wanted for r in table.tolist()], bool)
                yield table[own], support[own]
        if not len(table):
            return


def _chunked(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks (run_id, documents, chunks, width, code, loc) to rows of one chunk each, with packed positions."""
    for batch in batches:
        if not batch.num_rows:
            continue
        run, documents, chunks, width, code = (np.asarray(batch.column(i)) for i in range(5))
        loc = batch.column(5)
        lengths = np.asarray(pa.compute.list_value_length(loc))
        values = np.asarray(pa.compute.fill_null(loc.flatten(), postings.UNKNOWN)).astype(np.int64)
        row, doc, pos, _, _ = postings.decode(values, np.concatenate([[0], np.cumsum(lengths)]))
        known = doc != -postings.UNKNOWN - 1
        row, doc, pos = row[known], doc[known], pos[known]
        if not len(row):
            continue
        chunk = doc % chunks[row]
        order = np.lexsort((chunk, row))
        row, chunk, packed = row[order], chunk[order], ((doc << _POS) | pos)[order]
        start = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(chunk) != 0)]))
        offsets = pa.array(np.append(start, len(row)).astype(np.int32))
        own = row[start]
        yield pa.RecordBatch.from_arrays([pa.array(run[own]), pa.array(chunk[start].astype(np.int32)), pa.array(documents[own]), pa.array(chunks[own].astype(np.int32)), pa.array(width[own].astype(np.int32)), pa.array(code[own].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(packed))], schema=schema)


_CHUNK_SQL = "run_id bigint, chunk int, documents bigint, chunks int, width int, code int, packed array<bigint>"
_CHUNK_ARROW = pa.schema([("run_id", pa.int64()), ("chunk", pa.int32()), ("documents", pa.int64()), ("chunks", pa.int32()), ("width", pa.int32()), ("code", pa.int32()), ("packed", pa.list_(pa.int64()))])
_FOUND_SQL = "run_id bigint, chunk int, codes array<int>, support bigint"


def _entries(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    packed = group.column("packed").combine_chunks()
    if isinstance(packed, pa.ChunkedArray):
        packed = pa.concat_arrays(packed.chunks)
    return np.asarray(packed.flatten()), np.repeat(np.asarray(group.column("code")), np.asarray(pa.compute.list_value_length(packed)))


def _found(group: pa.Table, lengths: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    run, chunk = group.column("run_id")[0].as_py(), group.column("chunk")[0].as_py()
    codes: list[list[int]] = []
    support: list[int] = []
    for table, counts in lengths:
        codes += table.tolist()
        support += counts.tolist()
    return pa.table([pa.array([run] * len(codes), pa.int64()), pa.array([chunk] * len(codes), pa.int32()), pa.array(codes, pa.list_(pa.int32())), pa.array(support, pa.int64())], schema=_FOUND)


def frequent_patterns(blocks: DataFrame, shortest: int = 3, longest: int = 4, gap: int = 3, least: int = 5, share: float = 0.1, chunk: int = CHUNK) -> DataFrame:
    """(run_id, pattern, support): patterns of ``shortest`` to ``longest`` tokens, each at most ``gap`` positions after the one before.

    ``blocks`` has (run_id, ngram, ngram_size, loc); only single tokens are read. A pattern is frequent in at
    least ``least`` documents and at least ``share`` of the documents of its run. Blocks with a null run, token or list, and empty ones, are left
    out. Repeated blocks count once. Two different tokens at one position of a document (which a run never has): one of them is taken.
    """
    one = blocks.where((F.col("ngram_size") == 1) & F.col("ngram").isNotNull() & F.col("run_id").isNotNull() & (F.size("loc") > 0)).select("run_id", "ngram", "loc")
    documents = postings.count_documents(one, ["run_id"])
    bound = one.groupBy("run_id", "ngram").agg(F.sum(F.size(F.filter("loc", lambda x: x < 0))).alias("opens"), F.sum(F.size("loc")).alias("entries"))
    least_support = F.greatest(F.lit(float(least)), F.lit(share) * F.col("documents") - 1e-9)
    able = bound.join(documents, "run_id").where(F.col("opens") >= least_support)
    runs = able.groupBy("run_id", "documents").agg(F.sum("entries").alias("entries"), F.array_sort(F.collect_list("ngram")).alias("vocabulary"))
    runs = cut(runs.withColumn("chunks", F.ceil(F.col("entries") / chunk).cast("int")))
    tokens = runs.select("run_id", "documents", "chunks", F.size("vocabulary").alias("width"), F.posexplode("vocabulary").alias("code", "ngram"))
    if runs.agg(F.coalesce(F.sum(F.size("vocabulary")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        tokens = F.broadcast(tokens)
    rows = one.join(tokens, ["run_id", "ngram"]).select("run_id", "documents", "chunks", "width", "code", "loc").mapInArrow(lambda it: _chunked(it, _CHUNK_ARROW), _CHUNK_SQL)

    def local(group: pa.Table) -> pa.Table:
        packed, token = _entries(group)
        first = group.slice(0, 1).to_pylist()[0]
        whole = first["chunks"] == 1
        n = first["documents"] if whole else len(np.unique(packed >> _POS))
        threshold = max(least if whole else 1, math.ceil(share * n - 1e-9))
        return _found(group, mine(packed, token, first["width"], threshold, gap, longest, shortest))

    def counted(group: pa.Table, candidates: pa.Table) -> pa.Table:
        if not group.num_rows or not candidates.num_rows:
            return _FOUND.empty_table()
        packed, token = _entries(group)
        return _found(group, mine(packed, token, group.column("width")[0].as_py(), 0, gap, longest, shortest, candidates.column("codes").to_pylist()))

    found = rows.groupBy("run_id", "chunk").applyInArrow(local, _FOUND_SQL)
    if not runs.where("chunks > 1").isEmpty():
        found = cut(found)
        many = runs.where("chunks > 1").select("run_id", "chunks")
        candidates = found.join(many, "run_id").select("run_id", "chunks", "codes").distinct()
        candidates = candidates.select("run_id", "codes", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        again = rows.where("chunks > 1").groupBy("run_id", "chunk").cogroup(candidates.groupBy("run_id", "chunk")).applyInArrow(counted, _FOUND_SQL)
        found = found.join(many, "run_id", "left_anti").unionByName(again).groupBy("run_id", "codes").agg(F.sum("support").alias("support"))
    named = found.join(runs.select("run_id", "documents", "vocabulary"), "run_id").where(F.col("support") >= least_support)
    return named.select("run_id", F.array_join(F.transform("codes", lambda i: F.element_at("vocabulary", i + 1)), " ").alias("pattern"), "support")
