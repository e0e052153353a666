"""Frequency of every term: occurrences and records that hold it, by sorting and scanning runs.

Pairs of term and record identifier are sorted over range partitions; a scan of each sorted
partition counts runs of equal pairs. As ranges are cut by term *and* record, a term that owns most pairs is
spread over many partitions, and no record of a term is ever cut in two; the scan's partial counts are then simply added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.operators import postings

_OUT = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("documents", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over sorted (term, run_id, docpos, mask); the last run of a batch is carried into the next."""
    held: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        term, run, at, mask = (batch.column(i) for i in range(4))
        run, at, mask = np.asarray(run), np.asarray(at), np.asarray(mask).view(np.uint64)
        if held is not None:
            term = pa.concat_arrays([pa.array([held[0]], pa.string()), term])
            run, at, mask = np.append(held[1], run), np.append(held[2], at), np.append(np.uint64(held[3]), mask)
        coded = term.dictionary_encode()
        code = np.asarray(coded.indices)
        start = np.flatnonzero(np.concatenate([[True], (np.diff(code) != 0) | (np.diff(run) != 0) | (np.diff(at) != 0)]))
        merged = np.bitwise_or.reduceat(mask, start)
        last = int(start[-1])
        held = (coded.dictionary[int(code[last])].as_py(), int(run[last]), int(at[last]), int(merged[-1]))
        yield from _counted(coded.dictionary, code[start[:-1]], at[start[:-1]], merged[:-1])
    if held is not None:
        yield from _counted(pa.array([held[0]], pa.string()), np.zeros(1, np.int64), np.array([held[2]]), np.array([held[3]], np.uint64))


def _counted(terms: pa.Array, code: np.ndarray, at: np.ndarray, mask: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(code):
        start = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
        bits = np.add.reduceat(np.bitwise_count(mask).astype(np.int64), start)
        docs = np.add.reduceat(((at & 0xFFFFFF) == 0).astype(np.int64), start)
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(code[start])), pa.array(bits), pa.array(docs)], schema=_OUT)


def term_frequencies(masks: DataFrame) -> DataFrame:
    """Per term: ``occurrences`` and ``documents`` (distinct records).

    ``masks`` has (term string, run_id, docpos, mask) as ``postings.position_masks`` makes them: a record is its run and
    number, occurrences are bits. Repeated rows count once. Rows with a null in term or run are left out.
    """
    keys = ["term", "run_id", "docpos"]
    pairs = masks.select(*keys, "mask").where(F.col("term").isNotNull() & F.col("run_id").isNotNull())
    runs = pairs.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_scan, "term string, occurrences bigint, documents bigint")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def marked(frequencies: DataFrame, all_documents: DataFrame, rare: int = 5, common: float = 0.25) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``rare`` documents, ``common`` above the share ``common`` of all documents, else null.

    ``all_documents`` is one row with ``n``, so it may be broadcast. A term that is both is rare.
    """
    mark = F.when(F.col("documents") < rare, "rare").when(F.col("documents") > F.lit(common) * F.col("n"), "common")
    return frequencies.crossJoin(F.broadcast(all_documents)).withColumn("mark", mark).drop("n")


def _blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("ngram_size") == 1) & F.col("ngram").isNotNull() & F.col("run_id").isNotNull())


def token_frequencies(blocks: DataFrame, rare: int = 5, common: float = 0.25) -> DataFrame:
    """(ngram, occurrences, documents, mark) of every single token of the occurrence lists."""
    one = _blocks(blocks)
    masks = postings.position_masks(one, ["ngram", "run_id"]).withColumnRenamed("ngram", "term")
    every = postings.count_documents(one, ["run_id"]).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"))
    return marked(term_frequencies(masks), every, rare, common).withColumnRenamed("term", "ngram")


def rule_frequencies(rules: DataFrame, rare: int = 5, common: float = 0.25) -> DataFrame:
    """(ngram, occurrences, documents, mark) of every rule: an occurrence is a step of a run that names a document.

    A rule delivered twice repeats its step and counts once. Steps that are null count as step 0. Rules whose lists are null, empty
    or negative have no documents and are left out. All documents are those that any rule names.
    """
    step = F.coalesce(F.col("step"), F.lit(0)).cast("bigint")
    named = rules.where(F.col("ngram").isNotNull() & F.col("run_id").isNotNull()).select(F.col("ngram").alias("term"), "run_id", step.alias("step"), F.explode("loc").alias("doc")).where("doc >= 0").withColumn("doc", F.col("doc").cast("bigint"))
    bit = F.expr("shiftleft(1L, cast(step & 63 as int))")
    both = F.explode(F.array(F.struct((F.col("doc") * 2**24).alias("docpos"), F.when(F.expr("step div 64 = 0"), bit).otherwise(F.lit(0).cast("bigint")).alias("mask")), F.struct((F.col("doc") * 2**24 + F.expr("step div 64")).alias("docpos"), bit.alias("mask"))))
    masks = named.select("term", "run_id", both.alias("b")).select("term", "run_id", "b.docpos", "b.mask")
    every = named.groupBy("run_id", F.expr("doc div 64").alias("g")).agg(F.bit_or(F.expr("shiftleft(1L, cast(doc & 63 as int))")).alias("m")).agg(F.coalesce(F.sum(F.bit_count("m")), F.lit(0)).cast("bigint").alias("n"))
    return marked(term_frequencies(masks), every, rare, common).withColumnRenamed("term", "ngram")
