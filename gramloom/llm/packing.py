"""Filling containers of fixed capacity, by minimum bin slack.

Items are spread over groups of bounded size by a hash, and each group is packed on its own; with
thousands of items in a group nothing is lost by that. In a group, a container first takes the longest item left; a
subset-sum program over the available lengths, kept as bits of one number, then finds the fullest feasible combination to add to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a group, about.
GROUP = 16_384
#: Numbers of containers that hold one full piece start here; those of groups lie below.
FULL = 2**62
#: Container kinds that may be given.
KINDS = 1_000

_SQL = "container_name string, doc_id bigint, piece int, container_no bigint, tokens bigint"
_ARROW = pa.schema([("container_name", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("container_no", pa.int64()), ("tokens", pa.int64())])


def fullest(left: dict[int, int], order: list[int], room: int) -> list[int]:
    """Lengths (each as often as it is left) whose sum is the largest that is at most ``room``; ``order`` has the lengths, longest first.

    Bit s of ``reach`` says that some combination sums to s. Multiples of a length are added in powers of two; the
    states before each addition are kept, and the combination is read back from them.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    for length in order:
        if length > room or not left[length]:
            continue
        n, k = min(left[length], room // length), 1
        while n > 0:
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & full
            n -= k
            k *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * k
            at -= length * k
    return chosen


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container number, from 0 on, for each item. Items of size 0 take no room and go into container 0."""
    out = np.zeros(len(sizes), np.int64)
    items: dict[int, list[int]] = {}
    for i in np.flatnonzero(sizes > 0):
        items.setdefault(int(sizes[i]), []).append(int(i))
    order = sorted(items, reverse=True)
    left = {n: len(x) for n, x in items.items()}
    number, top = 0, 0
    while True:
        while top < len(order) and not left[order[top]]:
            top += 1
        if top == len(order):
            return out
        if top > 64:
            order, top = [n for n in order[top:] if left[n]], 0
        first = order[top]
        left[first] -= 1
        chosen = fullest(left, order[top:] if top else order, capacity - first) if first < capacity else []
        out[items[first].pop()] = number
        for n in chosen:
            left[n] -= 1
            out[items[n].pop()] = number
        number += 1


def _packed(group: pa.Table) -> pa.Table:
    sizes = np.asarray(group.column("tokens"))
    number = pack(sizes, int(group.column("capacity")[0].as_py())) + (int(group.column("bucket")[0].as_py()) << 32)
    return pa.table([group.column("container_name"), group.column("doc_id"), group.column("piece"), pa.array(number), group.column("tokens")], schema=_ARROW)


def pack_documents(sized: DataFrame, containers: DataFrame, group: int = GROUP) -> DataFrame:
    """(container_name, doc_id, piece, container_no, tokens) of every document for every kind of container.

    ``sized`` has (doc_id, tokens). A document larger than the capacity becomes pieces of the full capacity and a rest; others stay whole
    (piece 0). A container number is unique within its kind. Documents without tokens, a null count among them, get a number too. Repeated and null ids
    are items like any other. ``containers`` is a small parameter table: more than ``KINDS`` rows are refused; rows with a null or a capacity below 1 are left out.
    """
    kinds = [(r["container_name"], r["capacity_tokens"]) for r in containers.where("container_name is not null and capacity_tokens > 0").distinct().limit(KINDS + 1).collect()]
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} kinds of containers")
    if not kinds:
        return sized.sparkSession.createDataFrame([], _SQL)
    buckets = max(1, round(sized.count() / group))
    salt = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.rand(7))), F.lit(buckets))
    items = sized.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("all"), salt.cast("int").alias("bucket"))
    items = items.withColumn("kind", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(int(c)).cast("bigint").alias("capacity")) for n, c in kinds))))
    count = F.greatest(F.lit(1).cast("bigint"), F.expr("(all + kind.capacity - 1) div kind.capacity"))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    size = F.least(F.col("kind.capacity"), F.col("all") - F.col("piece") * F.col("kind.capacity"))
    rows = items.select(F.col("kind.name").alias("container_name"), F.col("kind.capacity").alias("capacity"), "bucket", "doc_id", "piece", F.greatest(size, F.lit(0)).cast("bigint").alias("tokens"))
    # a piece of the full capacity is a container of its own, so a group has at most one item of each document
    full = rows.where("tokens = capacity").select("container_name", "doc_id", "piece", (F.monotonically_increasing_id() + F.lit(FULL)).alias("container_no"), "tokens")
    return rows.where("tokens < capacity").groupBy("container_name", "bucket").applyInArrow(_packed, _SQL).unionByName(full)


def usage(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, tokens, and the share of room left unused."""
    used = packed.groupBy("container_name").agg(F.countDistinct("container_no").alias("n_containers"), F.sum("tokens").alias("tokens"))
    return used.join(containers.select("container_name", "capacity_tokens").distinct(), "container_name").select("container_name", "n_containers", "tokens", (1 - F.col("tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("unused_share"))


def checked(packed: DataFrame, sized: DataFrame, containers: DataFrame, slack: float = 0.01) -> DataFrame:
    """What must hold, per kind: ``n_documents`` placed, ``whole`` (pieces add up to each document, and only documents above the capacity are cut), ``overfull``
    containers, and ``tight`` (at most ``slack`` more containers than the tokens need, and one). ``sized`` has each doc_id once."""
    kinds = containers.where("container_name is not null and capacity_tokens > 0").select("container_name", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    placed = packed.groupBy("container_name", "doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"))
    both = placed.join(sized.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("all")), "doc_id").join(F.broadcast(kinds), "container_name")
    whole = (F.col("placed") == F.col("all")) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("all") / F.col("capacity"))))
    per = both.groupBy("container_name").agg(F.count("*").alias("n_documents"), F.every(whole).alias("whole"))
    used = packed.groupBy("container_name", "container_no").agg(F.sum("tokens").alias("used")).join(F.broadcast(kinds), "container_name")
    room = used.groupBy("container_name").agg(F.count_if(F.col("used") > F.col("capacity")).alias("overfull"), (F.count("*") <= 1 + F.ceil((1 + slack) * F.ceil(F.sum("used") / F.max("capacity")))).alias("tight"))
    return per.join(room, "container_name").select("container_name", "n_documents", "whole", "overfull", "tight")
