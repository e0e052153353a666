"""Records of evaluation splits that also stand, equal or slightly changed, in the training split.

Texts that are equal in letters and digits form a class; one text per class is compared. Each text gets a similarity hash, a fingerprint of 960
bits: 96 codes of ten bits, the lowest bits of min-wise hashes of its character grams, so that a code of two texts is equal with the probability of
their resemblance. The fingerprint is cut into 32 segments of three codes. Equal segments are joined across splits, apart by bands of text length so that a
segment that many texts share is cut up; a pair is kept if its lengths allow it and the lowest bits of the 96 codes lie within a Hamming radius, and
its edit distance is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm import grams
from gramloom.llm.records import exchanged, letters_digits
from gramloom.tables import cut

#: Codes of a fingerprint, its segments, and bits of a code.
CODES, SEGMENTS, WIDTH = 96, 32, 10
#: Characters in a gram; in texts shorter than ``SHORT`` one less. Texts that may have a partner on the other side are printed with both.
GRAM, SHORT = 4, 40
#: Bits of 96 in which a pair may differ: unrelated texts differ in 48 (deviation 5), those of 10 per cent edits in about 22 (4).
RADIUS = 34
#: Steps of the logarithm of a length that is carried with the last 32 bits.
STEPS = 100
#: A class with more than this share of all records, and more than ``PART``, is hot: fewer than 1 / share on each side. Its members are paired in parts of about ``PART``.
HOT, PART = 0.001, 2_000

_SQL = "class_id bigint, keys array<bigint>, bits bigint, more bigint"
_ARROW = pa.schema([("class_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.int64()), ("more", pa.int64())])


def fingerprints(texts: pa.Array, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(segments, bits): the 32 segments of each text's fingerprint, numbered, and the lowest bits of its codes, 64 and 32 in two words. A text too short for a gram is its own single gram.

    ``other`` takes the grams of the other side of ``SHORT``; such texts have at least ``GRAM`` characters.
    """
    points, offsets = grams.code_points(texts)
    length = np.diff(offsets)
    out = np.empty((len(length), CODES), np.uint64)
    long = (length >= SHORT) != other
    for k, chosen in ((GRAM, long), (GRAM - 1, ~long & (length >= GRAM - 1)), (0, ~long & (length < GRAM - 1))):
        rows = np.flatnonzero(chosen)
        if not len(rows):
            continue
        if k:
            n = length[rows] - k + 1
            start = np.cumsum(n) - n
            at = np.repeat(offsets[rows], n) + np.arange(int(n.sum())) - np.repeat(start, n)
            every = grams.gram_hashes(points, k)[at]
        else:
            start = np.arange(len(rows))
            every = grams.mixed(np.array([hash_short(points[offsets[i] : offsets[i + 1]]) for i in rows], np.uint64))
        with np.errstate(over="ignore"):
            for j in range(CODES):
                shift = grams.mixed(np.uint64([j + 1]))[0]
                out[rows, j] = np.minimum.reduceat((every ^ shift) * (shift | np.uint64(1)), start)
    code = grams.mixed(out) & np.uint64(2**WIDTH - 1)
    segments = np.zeros((len(length), SEGMENTS), np.uint64)
    for part in np.moveaxis(code.reshape(len(length), SEGMENTS, -1), 2, 0):
        segments = (segments << np.uint64(WIDTH)) | part
    segments |= np.arange(SEGMENTS, dtype=np.uint64) << np.uint64(32)
    low, place = code & np.uint64(1), np.arange(64, dtype=np.uint64)
    bits = np.stack([(low[:, :64] << place).sum(axis=1, dtype=np.uint64), (low[:, 64:] << place[: CODES - 64]).sum(axis=1, dtype=np.uint64)], axis=1)
    return segments.view(np.int64), bits.view(np.int64)


def hash_short(points: np.ndarray) -> int:
    """A number for a text of at most two characters."""
    return int(sum((int(p) + 1) << (32 * i) for i, p in enumerate(points)))


def _near_short(lengths: np.ndarray, share: float) -> np.ndarray:
    """Whether a text of this length can have a partner on the other side of ``SHORT``."""
    # a character more on both sides, for rounding
    return (lengths >= max((1 - share) * SHORT - 1, GRAM)) & ((1 - share) * lengths <= SHORT + 1)


def _band(length: np.ndarray) -> np.ndarray:
    """A number for lengths; those that a pair may have lie in the same band or in two neighbouring ones."""
    return np.floor(np.log(np.maximum(length, 0) + 1) / math.log(3)).astype(np.int64)


def _printed(batches: Iterator[pa.RecordBatch], share: float, both: bool) -> Iterator[pa.RecordBatch]:
    """(class_id, text) to a row for each text and band of lengths, and one more with the other grams for those near ``SHORT``.

    A key is a segment and a band: the text's own, or with ``both`` also those that a partner's length may lie in. ``more`` has the last bits and the length's logarithm.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, 2000):
            part = batch.slice(i, 2000)
            near = part.filter(pa.array(_near_short(np.asarray(pa.compute.utf8_length(part.column(1))), share)))
            for rows, other in ((part, False), (near, True)):
                if not rows.num_rows:
                    continue
                segments, bits = fingerprints(rows.column(1), other)
                n = np.asarray(pa.compute.utf8_length(rows.column(1))).astype(float)
                low, high = (_band((1 - share) * n - 1), _band(n / (1 - share) + 1)) if both else (_band(n), _band(n))
                take = np.repeat(np.arange(rows.num_rows), high - low + 1)
                band = low[take] + np.arange(len(take)) - np.searchsorted(take, take)
                keys = segments[take] + (band << 40)[:, None]
                more = bits[:, 1] | (np.floor(STEPS * np.log(np.maximum(n, 1))).astype(np.int64) << 32)
                offsets = pa.array(np.arange(len(take) + 1, dtype=np.int32) * SEGMENTS)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(take)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array(bits[take, 0]), pa.array(more[take])], schema=_ARROW)


def _members(records: DataFrame) -> DataFrame:
    """(doc_id, side, split_name, source, key, text) of the records that can have pairs."""
    side = F.when(F.col("split_name") == "train", "train").when(F.col("split_name").isin("dev", "test"), "eval")
    own = exchanged(records).withColumn("side", side).where("doc_id is not null and side is not null and example_sequence is not null")
    own = own.select("doc_id", "side", "split_name", "source", letters_digits(F.col("example_sequence")).alias("text"))
    return own.withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def class_links(own: DataFrame, members: DataFrame, share: float) -> DataFrame:
    """(tk, ek, nt, ne): the keys of the training and evaluation texts that are close, with their numbers of records.

    ``own`` has (doc_id, text), ``members`` (doc_id, side, key), each id once.
    """
    count = lambda side: F.count_if(F.col("side") == side)
    number = members.groupBy("key").agg(F.min("doc_id").alias("class_id"), count("train").alias("n_train"), count("eval").alias("n_eval")).withColumnRenamed("key", "class_key")
    # by id, not by key: a text with many copies is moved once
    classes = own.select("doc_id", "text").join(number, F.col("doc_id") == F.col("class_id")).dropDuplicates(["class_id"])
    classes = cut(classes.select("class_id", F.col("class_key").alias("key"), "text", "n_train", "n_eval"))

    def side(there: str, both: bool, name: str) -> DataFrame:
        prints = classes.where(F.col(there) > 0).select("class_id", "text").mapInArrow(lambda it: _printed(it, share, both), _SQL)
        return prints.select(F.explode("keys").alias("segment"), F.col("class_id").alias(name), F.col("bits").alias(f"{name}1"), F.col("more").alias(f"{name}2"))

    apart = F.bit_count(F.col("t1").bitwiseXOR(F.col("e1"))) + F.bit_count(F.col("t2").bitwiseXOR(F.col("e2")).bitwiseAND(2**32 - 1))
    near = (apart <= RADIUS) & (F.abs(F.shiftright("t2", 32) - F.shiftright("e2", 32)) <= math.ceil(-STEPS * math.log(1 - share)) + 1)
    pairs = side("n_train", False, "t").join(side("n_eval", True, "e"), "segment").where((F.col("t") != F.col("e")) & near).select("t", "e").distinct()
    one = classes.select(F.col("class_id").alias("t"), F.col("text").alias("tt"), F.col("key").alias("tk"), F.col("n_train").alias("nt"))
    two = classes.select(F.col("class_id").alias("e"), F.col("text").alias("et"), F.col("key").alias("ek"), F.col("n_eval").alias("ne"))
    most = F.floor(F.lit(share) * F.greatest(F.length("tt"), F.length("et")) + 1e-9).cast("int")
    close = pairs.join(one, "t").join(two, "e").withColumn("most", most).where(F.abs(F.length("tt") - F.length("et")) <= F.col("most")).where(F.expr("levenshtein(tt, et, most) >= 0"))
    same = classes.where("n_train > 0 and n_eval > 0").select(F.col("key").alias("tk"), F.col("key").alias("ek"), F.col("n_train").alias("nt"), F.col("n_eval").alias("ne"))
    return close.select("tk", "ek", "nt", "ne").unionByName(same)


def cross_split_pairs(records: DataFrame, share: float = 0.1) -> DataFrame:
    """(train_id, eval_id): all pairs whose texts are at most ``share`` of the longer length apart in edits.

    ``records`` has (doc_id, class_label, example_sequence, split_name, source). Records with a null id, a null sequence or another split have no
    pairs. Texts without a letter or digit are equal to one another. An id delivered twice counts once. Members of hot classes are cut into parts by a
    hash, and each two parts meet in a group of their own, so that no task pairs more than about ``PART`` by ``PART`` of them.
    """
    own = _members(records)
    members = cut(own.select("doc_id", "side", "key").dropDuplicates(["doc_id"]))
    links = cut(class_links(own, members, share))
    # fewer than 1 / HOT keys on each side
    sizes = members.groupBy("side", "key").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    totals = members.groupBy("side").agg(F.count("*").alias("total"))
    hot = sizes.join(F.broadcast(totals), "side").where(F.col("n") > HOT * F.col("total")).select("side", "key", F.ceil(F.col("n") / PART).alias("parts"))
    hot = cut(hot)
    parted = members.join(F.broadcast(hot), ["side", "key"], "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(F.lit(0)))
    for side, name in (("train", "t"), ("eval", "e")):
        one = hot.where(F.col("side") == side).select(F.col("key").alias(f"{name}k"), F.col("parts").alias(f"{name}_parts"))
        links = links.join(F.broadcast(one), f"{name}k", "left").withColumn(f"{name}p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(f"{name}_parts"), F.lit(1)) - 1)))
    links = links.select("tk", "tp", "ek", "ep")
    train = parted.where("side = 'train'").select(F.col("doc_id").alias("train_id"), F.col("key").alias("tk"), F.col("part").alias("tp"))
    held = parted.where("side = 'eval'").select(F.col("doc_id").alias("eval_id"), F.col("key").alias("ek"), F.col("part").alias("ep"))
    place = ["tk", "tp", "ek", "ep"]
    return links.join(train, ["tk", "tp"]).join(links.join(held, ["ek", "ep"]), place).select("train_id", "eval_id")


def overlap_counts(records: DataFrame, share: float = 0.1) -> DataFrame:
    """Per split and source of the evaluation record: ``n_records`` with a partner in the training split, and ``n_pairs``. A null source is a group.

    Counted from the links of classes and the numbers of their records: no pairs of records are made.
    """
    own = _members(records)
    members = cut(own.select("doc_id", "side", "split_name", "source", "key").dropDuplicates(["doc_id"]))
    partners = class_links(own, members, share).groupBy(F.col("ek").alias("key")).agg(F.sum("nt").alias("n"))
    held = members.where("side = 'eval'").groupBy("key", "split_name", "source").agg(F.count("*").alias("records"))
    return held.join(partners, "key").groupBy("split_name", "source").agg(F.sum("records").alias("n_records"), F.sum(F.col("records") * F.col("n")).alias("n_pairs"))
