"""Occurrence lists: decoding blocks of them, and totals per key without imbalance.

A list is an array of integers. A negative entry -(d+1) opens document d; the
non-negative entries after it are token positions in d. Lists come cut into blocks, a document may open in several
blocks and blocks may be delivered twice.

Documents are counted by states that may be merged in any order and any number of times (bit masks), so that repeated blocks count once. Sums of
occurrences need the repeated blocks, which are found by their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.tables import cut

#: Repeated blocks (16 bytes each) up to which they are broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Stands for a null entry of a list; no document has this number.
UNKNOWN = -(2**31)


def opened_documents(loc: str | Column) -> Column:
    """The documents that a block opens, from 0 on; null for a null block."""
    loc = F.col(loc) if isinstance(loc, str) else loc
    return F.transform(F.filter(loc, lambda x: x < 0), lambda x: -x - 1)


def decode(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For flat list values and the rows' offsets: row, document, position of every position entry, and row and document of every opening.

    Positions before the first opening of their row belong to no document and are left out.
    """
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    opening = values < 0
    last = np.maximum.accumulate(np.where(opening, np.arange(len(values)), -1)) if len(values) else np.zeros(0, np.int64)
    own = ~opening & (last >= offsets[:-1][rows]) if len(values) else np.zeros(0, bool)
    at = last[own]
    return rows[own], -(values[at].astype(np.int64)) - 1, values[own].astype(np.int64), rows[opening], -(values[opening].astype(np.int64)) - 1


def _masks(batches: Iterator[pa.RecordBatch], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        loc = batch.column(len(names))
        lengths = np.asarray(pa.compute.list_value_length(loc))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        values = np.asarray(pa.compute.fill_null(loc.flatten(), UNKNOWN)).astype(np.int64)
        row, doc, pos, open_row, open_doc = decode(values, offsets)
        row, doc = np.concatenate([row, open_row]), np.concatenate([doc, open_doc])
        bucket = np.concatenate([pos >> 6, np.zeros(len(open_row), np.int64)])
        bit = np.concatenate([np.left_shift(np.uint64(1), (pos & 63).astype(np.uint64)), np.zeros(len(open_row), np.uint64)])
        if len(row):
            order = np.lexsort((bucket, doc, row))
            row, doc, bucket, bit = row[order], doc[order], bucket[order], bit[order]
            start = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(doc) != 0) | (np.diff(bucket) != 0)]))
            row, doc, bucket, bit = row[start], doc[start], bucket[start], np.bitwise_or.reduceat(bit, start)
            known = doc != -UNKNOWN - 1
            row, doc, bucket, bit = row[known], doc[known], bucket[known], bit[known]
        take = pa.array(row, pa.int64())
        kept = [batch.column(i).take(take) for i in range(len(names))]
        cols = [*kept, pa.array((doc << 24) | bucket, pa.int64()), pa.array(bit.view(np.int64), pa.int64())]
        yield from pa.Table.from_arrays(cols, schema=schema).to_batches(max_chunksize=50_000)


def position_masks(blocks: DataFrame, keys: list[str], loc: str = "loc") -> DataFrame:
    """Rows (keys, ``docpos``, ``mask``): the positions of one document, 64 to a row, as bits.

    ``docpos`` holds the document (high bits) and position // 64 (low 24 bits). Bucket 0 of every opened document is always there, so
    rows of bucket 0, once merged, count the documents. Null and empty lists give no rows. A null entry opens an
    unknown document: it and the positions after it, up to the next opening, give no rows.
    """
    out = blocks.select(*keys, loc).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.fields[:-1]) + ", docpos bigint, mask bigint"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [pa.field(f.name, arrow[f.dataType.simpleString()]) for f in out.fields[:-1]]
    kept = pa.schema([*fields, pa.field("docpos", pa.int64()), pa.field("mask", pa.int64())])
    return blocks.where(F.size(loc) > 0).select(*keys, loc).mapInArrow(lambda it, k=list(keys), s=kept: _masks(it, k, s), schema)


def _positions(batches: Iterator[pa.RecordBatch], n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        loc = batch.column(n)
        offsets = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.list_value_length(loc)))]).astype(np.int64)
        row, doc, pos, _, _ = decode(np.asarray(pa.compute.fill_null(loc.flatten(), UNKNOWN)).astype(np.int64), offsets)
        known = doc != -UNKNOWN - 1
        take = pa.array(row[known])
        cols = [*(batch.column(i).take(take) for i in range(n)), pa.array(doc[known].astype(np.int32)), pa.array(pos[known].astype(np.int32))]
        yield from pa.Table.from_arrays(cols, schema=schema).to_batches(max_chunksize=50_000)


def token_positions(blocks: DataFrame, keys: list[str], loc: str = "loc") -> DataFrame:
    """Rows (keys, ``doc``, ``pos``): every position entry with its document. Blocks delivered twice repeat their rows."""
    own = blocks.where(F.size(loc) > 0).select(*keys, loc)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1]) + ", doc int, pos int"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kept = pa.schema([*(pa.field(f.name, arrow[f.dataType.simpleString()]) for f in own.schema.fields[:-1]), pa.field("doc", pa.int32()), pa.field("pos", pa.int32())])
    return own.mapInArrow(lambda it, n=len(keys), s=kept: _positions(it, n, s), schema)


def documents_of(blocks: DataFrame) -> DataFrame:
    """(run_id, doc, tokens) of the documents of each run, rebuilt from the occurrence lists of single tokens."""
    one = blocks.where((F.col("ngram_size") == 1) & F.col("ngram").isNotNull() & F.col("run_id").isNotNull())
    rows = token_positions(one, ["run_id", "ngram"])
    order = F.array_sort(F.collect_set(F.struct("pos", "ngram")))
    return rows.groupBy("run_id", "doc").agg(F.transform(order, lambda x: x["ngram"]).alias("tokens"))


def lowest_bit(mask: Column) -> Column:
    """Number of the lowest bit set in a non-zero mask."""
    last = F.lit(-(2**63))
    return F.when(mask == last, 63).otherwise(F.bit_count(F.shiftrightunsigned(mask.bitwiseXOR(mask - 1), 1)))


def highest_bit(mask: Column) -> Column:
    """Number of the highest bit set in a non-zero mask."""
    return F.length(F.bin(mask)) - 1


def document_masks(blocks: DataFrame, keys: list[str], loc: str = "loc") -> DataFrame:
    """Rows (keys, ``doc_group``, ``docs``): the documents opened in each group of 64, as bits, merged."""
    one = blocks.select(*keys, F.explode(opened_documents(loc)).alias("__doc"))
    bit = F.expr("shiftleft(1L, cast(__doc & 63 as int))")
    return one.groupBy(*keys, F.expr("__doc div 64").alias("doc_group")).agg(F.bit_or(bit).alias("docs"))


def count_documents(blocks: DataFrame, keys: list[str], loc: str = "loc") -> DataFrame:
    """Rows (keys, ``documents``): exact numbers of distinct documents."""
    return document_masks(blocks, keys, loc).groupBy(*keys).agg(F.sum(F.bit_count("docs")).cast("bigint").alias("documents"))


def key_totals(masks: DataFrame, keys: list[str], within: list[str]) -> DataFrame:
    """Per key: ``occurrences``, ``documents``, ``first_pos``, ``last_pos``.

    ``masks`` has (keys, within, docpos, mask), documents being numbered inside each ``within``. Both aggregates
    combine on the map side in bounded hash tables that spill. The first spreads even a
    key that owns most rows over all tasks by document; the second moves one compact row for each key and task.
    A key whose documents hold no positions has null positions and 0 occurrences.
    """
    merged = masks.groupBy(*keys, *within, "docpos").agg(F.bit_or("mask").alias("mask"))
    start = F.expr("(docpos & 16777215) * 64")
    some = F.col("mask") != 0
    return merged.groupBy(*keys).agg(
        F.sum(F.bit_count("mask")).cast("bigint").alias("occurrences"),
        F.count_if(F.expr("(docpos & 16777215) = 0")).alias("documents"),
        F.min(F.when(some, start + lowest_bit(F.col("mask")))).cast("bigint").alias("first_pos"),
        F.max(F.when(some, start + highest_bit(F.col("mask")))).cast("bigint").alias("last_pos"),
    )


def _repeats(blocks: DataFrame) -> DataFrame:
    """(block_id, copies) of blocks that were delivered more than once; a narrow aggregate over ids alone."""
    return blocks.where(F.col("block_id").isNotNull()).groupBy("block_id").agg(F.count("*").alias("copies")).where("copies > 1")


def _positions_of(loc: Column) -> Column:
    """(n, low, high): the positions of a list that belong to a document, as one pass over it where it has nulls or starts without an opening."""
    whole = (F.get(loc, F.lit(0)) < 0) & ~F.exists(loc, lambda x: x.isNull())
    top = F.array_max(loc)
    plain = F.struct(F.size(F.filter(loc, lambda x: x >= 0)).cast("bigint").alias("n"), F.array_min(F.filter(loc, lambda x: x >= 0)).alias("low"), F.when(top >= 0, top).alias("high"))
    start = F.struct(F.lit(False).alias("open"), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))

    def step(s: Column, x: Column) -> Column:
        counts = s["open"] & (x >= 0)
        own = F.coalesce(counts, F.lit(False))
        opened = F.when(x.isNull(), False).when(x < 0, True).otherwise(s["open"])
        return F.struct(opened.alias("open"), (s["n"] + own.cast("bigint")).alias("n"), F.when(own, F.least(s["low"], x)).otherwise(s["low"]).alias("low"), F.when(own, F.greatest(s["high"], x)).otherwise(s["high"]).alias("high"))

    folded = F.aggregate(loc, start, step, lambda s: F.struct(s["n"].alias("n"), s["low"].alias("low"), s["high"].alias("high")))
    return F.when(F.coalesce(whole, F.lit(False)), plain).otherwise(folded)


def block_totals(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ``occurrences``, ``first_pos``, ``last_pos``, from sums, minima and maxima alone, which combine on the map side to a row for each key and task.

    ``blocks`` has (block_id, keys, loc). Rows with the same block_id are one block delivered repeatedly; a null id is a block of its own. Repeats are found by
    ids alone and, up to ``BROADCAST_ROWS`` of them, sent to the blocks. Null entries open an unknown document, and positions before the first opening belong to none: neither counts. Keys
    without positions have 0 occurrences and null positions; null and empty lists give no rows.
    """
    own = blocks.where(F.size("loc") > 0)
    repeats = cut(_repeats(own))
    narrow = own.select("block_id", *keys, _positions_of(F.col("loc")).alias("p")).select("block_id", *keys, "p.*")
    marked = narrow.join(F.broadcast(repeats) if repeats.count() <= BROADCAST_ROWS else repeats, "block_id", "left")
    # copies of a block agree, so that their sum is a multiple
    sums = marked.groupBy(*keys, F.coalesce("copies", F.lit(1).cast("bigint")).alias("copies")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return sums.groupBy(*keys).agg(F.sum(F.expr("n div copies")).alias("occurrences"), F.min("low").cast("bigint").alias("first_pos"), F.max("high").cast("bigint").alias("last_pos"))


def heavy_keys(totals: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The keys that own at least ``share`` of all occurrences. The total is one row, so it may be broadcast."""
    whole = totals.agg(F.sum("occurrences").alias("__all"))
    return totals.crossJoin(F.broadcast(whole)).where((F.col("__all") > 0) & (F.col("occurrences") >= F.lit(share) * F.col("__all"))).drop("__all")
