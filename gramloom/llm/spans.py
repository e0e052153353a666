"""Long exact spans shared between records, and fuzzy passages: seeds, fragments, chains, alignment.

Equal texts form a class, and one text of each is compared. Seeds are the smallest-hashed k-mers of each window, so two equal spans of
the wanted length always share one at the same place. Occurrences of a seed that several texts hold are joined, each with the characters around it; two of them
are extended to the longest exact fragment within these characters, which covers every equal window that holds the seed. Fragments of two texts are chained in order with gap
costs (the best predecessor comes from a Fenwick tree), and chains are aligned: fragments on one diagonal become blocks, and the gaps between blocks cost edits.

Exact spans are the blocks of the chains of fragments that are long enough. As that result is exact, chains group its blocks but never decide which there are; they decide what
fuzzy passages there are. Seeds of many occurrences would give all pairs of a group. For spans their windows are hashed instead, 128 bits each, and a window is
shared if its smallest and largest text differ: an exact way whose cost is linear. For passages all pairs of a group are the result; they are compared in cells of
bounded size, or, if one row for each member of a group will do, each text is chained with one text of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramloom.llm import grams
from gramloom.llm.records import with_groups
from gramloom.tables import cut

SEED = 20
#: Occurrences of a seed up to which all are paired at once; beyond, spans come from hashed windows and passages from cells of pairs.
PAIRED = 16
#: Occurrences on a side of a cell, on average.
SIDE = 64
#: Rows of shared seeds or windows (some 30 bytes each) up to which they are broadcast; beyond, the joins are shuffled.
BROADCAST_ROWS = 1_000_000
#: Cost of a gap between fragments, per character by which a chain moves on in either text.
GAP_COST = 0.05
#: Pairs whose contexts are compared at once.
AT_ONCE = 20_000


def _seeds(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("seed", pa.int64()), ("class_id", pa.int64()), ("pos", pa.int32())])
    width = least - SEED + 1
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            points, offsets = grams.code_points(part.column(1))
            h = grams.gram_hashes(points, SEED)
            if len(h) < width:
                continue
            row = np.searchsorted(offsets, np.arange(len(h)), side="right") - 1
            h[np.arange(len(h)) + SEED > offsets[row + 1]] = np.iinfo(np.uint64).max
            low = grams.sliding(h, width, np.minimum)
            padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
            at = np.flatnonzero((grams.sliding(padded, width, np.maximum) == h) & (h != np.iinfo(np.uint64).max))
            own = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), part.column(0).take(pa.array(own)), pa.array((at - offsets[own]).astype(np.int32))], schema=schema)


def _windows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(class_id, text, seed positions) to hashes of all windows that hold one of the seeds."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("class_id", pa.int64()), ("start", pa.int32())])
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            points, offsets = grams.code_points(part.column(1))
            seeds, lists = np.asarray(part.column(2).flatten()).astype(np.int64), np.asarray(pa.compute.list_value_length(part.column(2)))
            row = np.repeat(np.arange(part.num_rows), lists)
            first, last = np.maximum(seeds + SEED - least, 0), np.minimum(seeds, np.diff(offsets)[row] - least)
            held = first <= last
            wanted = np.zeros(len(points) + 1, np.int64)
            np.add.at(wanted, (offsets[row] + first)[held], 1)
            np.add.at(wanted, (offsets[row] + last)[held] + 1, -1)
            start = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
            if len(start):
                own = np.searchsorted(offsets, start, side="right") - 1
                h1, h2 = grams.gram_hashes(points, least, 1)[start], grams.gram_hashes(points, least, 2)[start]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), part.column(0).take(pa.array(own)), pa.array((start - offsets[own]).astype(np.int32))], schema=schema)


class Fenwick:
    """Prefix maxima of (value, item), by place."""

    def __init__(self, size: int) -> None:
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        """Raises the maximum at a place (from 0)."""
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def until(self, place: int) -> tuple[float, int]:
        """The maximum over the places before ``place``."""
        top = (float("-inf"), -1)
        while place > 0:
            if self.best[place] > top:
                top = self.best[place]
            place -= place & -place
        return top


def chains(fragments: list[tuple[int, int, int]], cost: float = GAP_COST) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """All fragments (start in one, start in two, length) as chains that grow in both texts, best first: (score, fragments).

    A fragment scores the characters that the chain hasn't covered, less ``cost`` for each character between its start and the end of the one before, in both texts. A
    fragment belongs to the chain of its best successor; the others start where that is taken.
    """
    fragments = sorted(set(fragments))
    if len(fragments) == 1:
        return [(float(fragments[0][2]), fragments)]
    places = {y: i for i, y in enumerate(sorted({y for _, y, _ in fragments}))}
    tree, score, before = Fenwick(len(places)), [0.0] * len(fragments), [-1] * len(fragments)
    i = 0
    while i < len(fragments):
        j = i
        while j < len(fragments) and fragments[j][0] == fragments[i][0]:
            x, y, n = fragments[j]
            value, k = tree.until(places[y])
            score[j] = float(n)
            if k >= 0:
                a, b, m = fragments[k]
                fresh, gain = min(n, x + n - a - m, y + n - b - m), value - cost * (x + y)
                if fresh > 0 and gain + fresh > n:
                    score[j], before[j] = fresh + gain, k
            j += 1
        for m in range(i, j):
            x, y, n = fragments[m]
            tree.put(places[y], (score[m] + cost * (x + y + 2 * n), m))
        i = j
    out, taken = [], [False] * len(fragments)
    for i in sorted(range(len(fragments)), key=lambda i: -score[i]):
        chain, k = [], i
        while k >= 0 and not taken[k]:
            taken[k] = True
            chain.append(fragments[k])
            k = before[k]
        if chain:
            out.append((score[i], chain[::-1]))
    return out


def on_diagonals(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments that overlap or touch on one diagonal as one."""
    out: list[tuple[int, int, int]] = []
    for d, x, n in sorted((x - y, x, n) for x, y, n in set(fragments)):
        if out and out[-1][0] - out[-1][1] == d and x <= out[-1][0] + out[-1][2]:
            a, b, m = out[-1]
            out[-1] = (a, b, max(m, x + n - a))
        else:
            out.append((x, x - d, n))
    return sorted(out)


def edits(one: np.ndarray, two: np.ndarray) -> int:
    """The fewest insertions, deletions and replacements that make two gaps equal, a row of the table at a time."""
    if not len(one) or not len(two):
        return max(len(one), len(two))
    place = np.arange(len(two) + 1)
    row = place.copy()
    for i, c in enumerate(one, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (two != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])


_BLOCK = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
_PASSAGE = pa.schema([("class_1", pa.int64()), ("class_2", pa.int64()), ("start_1", pa.int32()), ("end_1", pa.int32()), ("start_2", pa.int32()), ("end_2", pa.int32()), ("score", pa.float64()), ("blocks", pa.list_(_BLOCK))])
_PASSAGE_SQL = "class_1 bigint, class_2 bigint, start_1 int, end_1 int, start_2 int, end_2 int, score double, blocks array<struct<a: int, b: int, n: int>>"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_1, class_2, fragments) to a row for each chain."""
    for batch in batches:
        lists = batch.column(2)
        ends = np.cumsum(np.asarray(pa.compute.list_value_length(lists))).tolist()
        flat = lists.flatten()
        a, b, n = (np.asarray(flat.field(i)).tolist() for i in range(3))
        own, starts_1, ends_1, starts_2, ends_2, scores, blocks, sizes, start = [], [], [], [], [], [], [], [], 0
        for i, end in enumerate(ends):
            for score, chain in chains(on_diagonals(list(zip(a[start:end], b[start:end], n[start:end], strict=True)))):
                own.append(i)
                starts_1.append(chain[0][0])
                ends_1.append(chain[-1][0] + chain[-1][2])
                starts_2.append(chain[0][1])
                ends_2.append(chain[-1][1] + chain[-1][2])
                scores.append(score)
                blocks += chain
                sizes.append(len(chain))
            start = end
        if own:
            parts = np.array(blocks, np.int32).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(parts[:, k]) for k in range(3)], fields=list(_BLOCK))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), structs)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *(pa.array(x, pa.int32()) for x in (starts_1, ends_1, starts_2, ends_2)), pa.array(scores), lists], schema=_PASSAGE)


def _seed_table(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(seed, n, class_id, pos) of the seeds that two or more texts hold, and (seed, n, low) of those alone."""
    seeds = texts.where(F.length("text") >= least).select("class_id", "text").mapInArrow(lambda it: _seeds(it, least), "seed bigint, class_id bigint, pos int")
    sizes = seeds.groupBy("seed").agg(F.count("*").alias("n"), F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("seed", "n", "low")
    sizes = cut(sizes)
    few = sizes.count() <= BROADCAST_ROWS
    return seeds.join(F.broadcast(sizes.select("seed", "n")) if few else sizes.select("seed", "n"), "seed").select("seed", "n", "class_id", "pos"), sizes


def _with_context(texts: DataFrame, occurrences: DataFrame, least: int) -> DataFrame:
    """Adds ``context``: up to ``least`` - ``SEED`` characters on either side of the seed, the seed included."""
    around = least - SEED
    start = F.greatest(F.col("pos") - around, F.lit(0))
    lists = occurrences.groupBy("class_id").agg(F.collect_list(F.struct("seed", "n", "pos")).alias("o"))
    rows = lists.join(texts.select("class_id", "text"), "class_id").select("class_id", "text", F.explode("o").alias("o")).select("o.seed", "o.n", "class_id", "o.pos", "text")
    return rows.select("seed", "n", "class_id", "pos", F.substring(F.col("text"), start + 1, F.col("pos") + SEED + around - start).alias("context"))


def _around(contexts: pa.Array, pos: np.ndarray, around: int) -> np.ndarray:
    """The characters around each seed, one row for each and its seed in the same columns; places outside of a text are below 0."""
    points, offsets = grams.code_points(contexts)
    left = np.minimum(pos, around)
    at = (offsets[:-1] + left)[:, None] + np.arange(-around, SEED + around)
    inside = (at >= offsets[:-1, None]) & (at < offsets[1:, None])
    return np.where(inside, np.append(points, 0).astype(np.int64)[np.minimum(at, len(points))], -1 - np.arange(len(pos))[:, None])


def _extended(one: np.ndarray, two: np.ndarray, around: int) -> tuple[np.ndarray, np.ndarray]:
    """How far two occurrences agree to the left of their seed and from its start to the right; -1 to the right where the seeds are not the same."""
    same = one == two
    pad = np.zeros((len(same), 1), bool)
    left = np.argmin(np.concatenate([same[:, :around][:, ::-1], pad], axis=1), axis=1)
    right = np.argmin(np.concatenate([same[:, around:], pad], axis=1), axis=1)
    return left, np.where(right >= SEED, right, -1)


_FRAGMENT = pa.schema([("class_1", pa.int64()), ("class_2", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
_FRAGMENT_SQL = "class_1 bigint, class_2 bigint, a int, b int, n int"


def _fragments(own: np.ndarray, pos: np.ndarray, around: np.ndarray, one: np.ndarray, two: np.ndarray, width: int, least: int) -> Iterator[pa.RecordBatch]:
    """The fragments of ``least`` or more characters of pairs of occurrences, the smaller class first."""
    for i in range(0, len(one), AT_ONCE):
        x, y = one[i : i + AT_ONCE], two[i : i + AT_ONCE]
        x, y = np.where(own[x] < own[y], x, y), np.where(own[x] < own[y], y, x)
        left, right = _extended(around[x], around[y], width)
        good = np.flatnonzero((right >= SEED) & (left + right >= least))
        x, y, left, n = x[good], y[good], left[good], (left + right)[good]
        yield pa.RecordBatch.from_arrays([pa.array(own[x]), pa.array(own[y]), *(pa.array(v.astype(np.int32)) for v in (pos[x] - left, pos[y] - left, n))], schema=_FRAGMENT)


def _paired(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    """Sorted (seed, class_id, pos, context) to the fragments of all pairs of occurrences of a seed in two texts. A seed that goes on in the next batch is held back.

    With a fifth column, rows with the same ``side`` from 0 on are not paired.
    """
    held: pa.RecordBatch | None = None

    def done(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seed, own, pos = (np.asarray(rows.column(i)).astype(np.int64) for i in range(3))
        around = _around(rows.column(3), pos, width)
        start = np.flatnonzero(np.concatenate([[True], np.diff(seed) != 0]))
        place = np.arange(len(seed)) - np.repeat(start, np.diff(np.append(start, len(seed))))
        # the k-th occurrence with each of the k before it
        two = np.repeat(np.arange(len(seed)), place)
        one = two - 1 - (np.arange(len(two)) - np.repeat(np.cumsum(place) - place, place))
        apart = own[one] != own[two]
        if rows.num_columns > 4:
            side = np.asarray(rows.column(4))
            apart &= (side[one] != side[two]) | (side[one] < 0)
        yield from _fragments(own, pos, around, one[apart], two[apart], width, least)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        seed = np.asarray(batch.column(0))
        last = int(np.searchsorted(seed, seed[-1]))
        if last:
            yield from done(batch.slice(0, last))
        held = batch.slice(last)
    if held is not None:
        yield from done(held)


def _starred(batches: Iterator[pa.RecordBatch], width: int, least: int) -> Iterator[pa.RecordBatch]:
    """(class_id, pos, context, other, other_pos, other_context) to fragments."""
    for batch in batches:
        n = batch.num_rows
        own, pos = (np.concatenate([np.asarray(batch.column(i)), np.asarray(batch.column(i + 3))]).astype(np.int64) for i in (0, 1))
        around = _around(pa.concat_arrays([batch.column(2), batch.column(5)]), pos, width)
        yield from _fragments(own, pos, around, np.arange(n), np.arange(n) + n, width, least)


def paired_fragments(contexts: DataFrame, least: int, shortest: int) -> DataFrame:
    """(class_1, class_2, a, b, n): fragments of ``shortest`` or more characters between all occurrences of seeds with few of them. A group has at most ``PAIRED`` rows."""
    rows = contexts.where(F.col("n") <= PAIRED).select("seed", "class_id", "pos", "context").repartition("seed").sortWithinPartitions("seed")
    return rows.mapInArrow(lambda it: _paired(it, least - SEED, shortest), _FRAGMENT_SQL)


def celled_fragments(contexts: DataFrame, least: int, shortest: int) -> DataFrame:
    """The same for seeds of many occurrences: these are divided into sides by hash, and each cell of two sides, or of one with itself, is compared apart, so that no task holds a whole group."""
    many = contexts.where(F.col("n") > PAIRED).withColumn("k", F.ceil(F.col("n") / SIDE)).withColumn("side", F.pmod(F.xxhash64("class_id", "pos"), F.col("k")))
    rows = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    # cells that collide do no harm: seeds are compared too, and sides differ in every pair that is wanted
    cell = F.xxhash64("seed", F.least("side", "other"), F.greatest("side", "other")).alias("cell")
    rows = rows.select(cell, "class_id", "pos", "context", F.when(F.col("side") == F.col("other"), F.lit(-1)).otherwise(F.col("side")).cast("bigint").alias("side"))
    rows = rows.repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(lambda it: _paired(it, least - SEED, shortest), _FRAGMENT_SQL)


def starred_fragments(contexts: DataFrame, sizes: DataFrame, least: int, shortest: int) -> DataFrame:
    """Fragments of seeds of many occurrences, each with the first occurrence in the group's smallest class alone."""
    many = contexts.where(F.col("n") > PAIRED).select("seed", "class_id", "pos", "context")
    heads = many.join(sizes.where(F.col("n") > PAIRED).select("seed", F.col("low").alias("class_id")), ["seed", "class_id"])
    heads = heads.groupBy("seed").agg(F.min_by(F.struct("class_id", "pos", "context"), "pos").alias("h")).select("seed", F.col("h.class_id").alias("other"), F.col("h.pos").alias("other_pos"), F.col("h.context").alias("other_context"))
    rows = many.join(heads, "seed").where("class_id <> other").select("class_id", "pos", "context", "other", "other_pos", "other_context")
    return rows.mapInArrow(lambda it: _starred(it, least - SEED, shortest), _FRAGMENT_SQL)


def passages(fragments: DataFrame, least: int = 0) -> DataFrame:
    """A row for each chain of fragments of two texts, with its blocks, of chains that reach over ``least`` characters in both texts."""
    grouped, found = fragments.groupBy("class_1", "class_2"), F.collect_set(F.struct("a", "b", "n")).alias("fragments")
    if not least:
        return grouped.agg(found).mapInArrow(_chained, _PASSAGE_SQL)
    # no chain reaches farther than all fragments of its texts
    reach = F.least(*(F.max(F.col(x) + F.col("n")) - F.min(x) for x in "ab"))
    lists = grouped.agg(found, reach.alias("reach")).where(F.col("reach") >= least).drop("reach")
    return lists.mapInArrow(_chained, _PASSAGE_SQL).where(f"end_1 - start_1 >= {least} and end_2 - start_2 >= {least}")


_ALIGNED = pa.schema([("class_1", pa.int64()), ("class_2", pa.int64()), *((x, pa.int32()) for x in ("start_1", "end_1", "start_2", "end_2")), ("score", pa.float64()), ("exact_chars", pa.int32()), ("edits", pa.int32())])
_ALIGNED_SQL = "class_1 bigint, class_2 bigint, start_1 int, end_1 int, start_2 int, end_2 int, score double, exact_chars int, edits int"


def _agreeing(one: np.ndarray, two: np.ndarray) -> int:
    n = min(len(one), len(two))
    unlike = np.flatnonzero(one[:n] != two[:n])
    return int(unlike[0]) if len(unlike) else n


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_1, class_2, score, blocks, text_1, text_2) to aligned passages: both ends as far as the texts agree, and the edits in the gaps."""
    for batch in batches:
        rows = []
        for blocks, one, two in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True):
            one, two = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (one, two))
            first, last, cost, agree = blocks[0], blocks[-1], 0, sum(p["n"] for p in blocks)
            for p, q in zip(blocks, blocks[1:], strict=False):
                a, b = one[p["a"] + p["n"] : q["a"]], two[p["b"] + p["n"] : q["b"]]
                head = _agreeing(a, b)
                tail = _agreeing(a[head:][::-1], b[head:][::-1])
                agree += head + tail
                cost += edits(a[head : len(a) - tail], b[head : len(b) - tail])
            left = _agreeing(one[: first["a"]][::-1], two[: first["b"]][::-1])
            x, y = last["a"] + last["n"], last["b"] + last["n"]
            right = _agreeing(one[x:], two[y:])
            rows.append((first["a"] - left, x + right, first["b"] - left, y + right, agree + left + right, cost))
        a, b, c, d, exact, cost = (pa.array(list(x), pa.int32()) for x in zip(*rows, strict=True)) if rows else (pa.array([], pa.int32()),) * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), a, b, c, d, batch.column(2), exact, cost], schema=_ALIGNED)


def aligned(chained: DataFrame, texts: DataFrame) -> DataFrame:
    """The chains with their ends as far as the texts agree, the characters that agree in blocks, and ``edits``: what the gaps between the blocks cost."""
    rows = chained.select("class_1", "class_2", "score", "blocks")
    for side in ("1", "2"):
        rows = rows.join(texts.select(F.col("class_id").alias(f"class_{side}"), F.col("text").alias(f"text_{side}")), f"class_{side}")
    return rows.select("class_1", "class_2", "score", "blocks", "text_1", "text_2").mapInArrow(_gaps, _ALIGNED_SQL)


def _common(texts: DataFrame, many: DataFrame, least: int) -> DataFrame:
    """(class_id, s, e): the shared windows around seeds of many occurrences."""
    at = many.groupBy("class_id").agg(F.collect_list("pos").alias("seeds"))
    windows = texts.join(at, "class_id").select("class_id", "text", "seeds").mapInArrow(lambda it: _windows(it, least), "h1 bigint, h2 bigint, class_id bigint, start int")
    # combined on the map side: a window that many texts hold costs one row a task
    shared = cut(windows.groupBy("h1", "h2").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("h1", "h2"))
    few = shared.count() <= BROADCAST_ROWS
    return windows.join(F.broadcast(shared) if few else shared, ["h1", "h2"]).select("class_id", F.col("start").alias("s"), (F.col("start") + least).alias("e"))


def _classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class_id, text) with texts as stored, and (doc_id, class_id, members); ids delivered twice once."""
    own = records.where("doc_id is not null and example_sequence is not null").select("doc_id", F.col("example_sequence").alias("text"))
    own = own.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    ids = cut(own.select("doc_id", "key").distinct())
    number = cut(ids.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members")))
    # by id, not by key: a text with many copies is moved once
    texts = own.join(number.select(F.col("class_id").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("class_id"), "text").dropDuplicates(["class_id"])
    return cut(texts), with_groups(ids, number, "members").select("doc_id", "class_id", "members")


def merged(spans: DataFrame, key: str = "class_id") -> DataFrame:
    """Unbroken stretches (key, s, e) of spans that overlap or touch."""
    order = Window.partitionBy(key).orderBy("s", "e")
    far = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.distinct().withColumn("new", F.when(far >= F.col("s"), 0).otherwise(1))
    return new.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def shared_spans(records: DataFrame, least: int = 60) -> DataFrame:
    """(doc_id, span_start, span_end): the longest stretches of characters each of which lies in a span of ``least`` that stands in another record too.

    ``records`` has (doc_id, example_sequence), compared as stored. Records with a null id or sequence, and those shorter than ``least``, have none;
    an id delivered twice is one record.
    """
    texts, ids = _classes(records)
    occurrences, _ = _seed_table(texts, least)
    occurrences = cut(occurrences)
    contexts = _with_context(texts, occurrences.where(F.col("n") <= PAIRED), least)
    blocks = passages(paired_fragments(contexts, least, least)).select("class_1", "class_2", F.explode("blocks").alias("x"))
    sides = F.explode(F.array(F.struct(F.col("class_1").alias("class_id"), F.col("x.a").alias("s"), (F.col("x.a") + F.col("x.n")).alias("e")), F.struct(F.col("class_2").alias("class_id"), F.col("x.b").alias("s"), (F.col("x.b") + F.col("x.n")).alias("e"))))
    spans = blocks.select(sides.alias("z")).select("z.*").unionByName(_common(texts, occurrences.where(F.col("n") > PAIRED), least))
    single = merged(spans).join(ids.where("members = 1").select("class_id", "doc_id"), "class_id").select("doc_id", F.col("s").alias("span_start"), F.col("e").alias("span_end"))
    lengths = texts.select("class_id", F.length("text").alias("n")).where(F.col("n") >= least)
    whole = ids.where("members > 1").join(lengths, "class_id").select("doc_id", F.lit(0).alias("span_start"), F.col("n").alias("span_end"))
    return single.unionByName(whole)


def fuzzy_passages(records: DataFrame, least: int = 60, every: bool = False) -> DataFrame:
    """Passages of ``least`` or more characters that two texts share but for some edits: where they lie, the chain's score, the characters that agree, and the edits.

    Records of equal texts are one class, named by its smallest id. With ``every``, all seeds that two texts share are chained, whatever the number of texts that hold them. Without,
    this is so for seeds of up to ``PAIRED`` occurrences only, and a text that shares a commoner passage is chained
    with the text of smallest id among those that hold its seed: pairs of one text for each group and its members, in place of all pairs of a group.
    """
    texts, _ = _classes(records)
    occurrences, sizes = _seed_table(texts, least)
    contexts = cut(_with_context(texts, occurrences, least))
    common = celled_fragments(contexts, least, SEED) if every else starred_fragments(contexts, sizes, least, SEED)
    fragments = paired_fragments(contexts, least, SEED).unionByName(common)
    # a fragment that ends where its context does has ``least`` characters, so shorter chains can't be extended
    return aligned(cut(passages(fragments, least)), texts).select(F.col("class_1").alias("doc_id_1"), F.col("class_2").alias("doc_id_2"), "start_1", "end_1", "start_2", "end_2", F.round("score", 3).alias("score"), "exact_chars", "edits")


def shared_share(records: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share) of every record; the share of an empty or null text is 0."""
    own = records.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.length("example_sequence"), F.lit(0))).alias("n_chars"))
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("span_end") - F.col("span_start")).cast("bigint").alias("c"))
    joined = own.join(sums, "doc_id", "left").withColumn("shared_chars", F.coalesce("c", F.lit(0)).cast("bigint"))
    return joined.select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "shared_chars", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)).alias("shared_share"))
