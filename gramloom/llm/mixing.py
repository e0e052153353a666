"""Mixing sources to target weights by Poisson replication.

A document's number of copies is the inverse of a Poisson distribution at a number hashed from the
document, cut off at its source's most repeats. It grows with the mean. The mean at which a document gets its j-th copy is
therefore a fixed number, and the mean that gives a source its target size is found from totals of these numbers: a table of at most
a few thousand rows for each source, refined once. Copies are then exploded and put into a global random order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gramloom.llm.tokens import uniform
from gramloom.tables import cut

#: Sources that may have targets, and repeats of a document.
SOURCES, REPEATS = 10_000, 1_000
#: Part of the largest mix that is possible without exceeding any source's repeats. At 1 the source that limits the mix uses every document as often as it may.
FILL = 1.0
#: Copies up to which a distribution's terms are added as they are; beyond, they could underflow.
DIRECT = 64
#: Steps in which a mean is sought, twice.
STEPS = 2_048


def _below(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(Poisson of mean x < a), the upper regularised gamma function, for whole a > 0: a series or a continued fraction, scaled by logarithms so that nothing underflows."""
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        scale = np.exp(a * np.log(x) - x - _log_factorial(a))
        series = x < a + 1
        # the lower function's series: x^a e^-x / a! * (1 + x/(a+1) + ...)
        n, term, total = a.astype(float), np.ones_like(x), np.ones_like(x)
        # the upper one's continued fraction, by its convergents
        one, tiny = x + 1 - a, 1e-300
        c, d = np.full_like(x, 1 / tiny), 1 / np.where(one == 0, tiny, one)
        h = d.copy()
        for i in range(1, 500):
            n = n + 1
            term = np.where(series, term * x / n, 0.0)
            total += term
            k = -i * (i - a)
            one = one + 2
            d = k * d + one
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = one + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = np.where(series, 1.0, d * c)
            h = h * step
            if i % 8 == 0 and (term <= 1e-16 * total).all() and (np.abs(step - 1) < 1e-15).all():
                break
        return np.where(series, 1 - scale * total, np.clip(scale * a * h, 0.0, 1.0))


def _log_factorial(a: np.ndarray) -> np.ndarray:
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(a.max(initial=1)) + 1)))])
    return table[a.astype(np.int64)]


def _few(u: np.ndarray, most: int) -> np.ndarray:
    """The same for up to ``DIRECT`` copies, whose terms can be added as they are."""
    out = np.empty((len(u), most))
    for j in range(1, most + 1):
        low, high = np.full(len(u), -60.0), np.full(len(u), np.log(j + 60.0 + 12 * np.sqrt(j)))
        for _ in range(60):
            mid = (low + high) / 2
            mean, term = np.exp(mid), np.exp(-np.exp(mid))
            below = term.copy()
            for i in range(1, j):
                term = term * mean / i
                below += term
            more = below > u
            low, high = np.where(more, mid, low), np.where(more, high, mid)
        out[:, j - 1] = np.exp((low + high) / 2)
    return out


def means(u: np.ndarray, most: int) -> np.ndarray:
    """For each number, the means from which on it yields 1, 2, ..., ``most`` copies: the roots of P(Poisson < j) = u, by bisection on the logarithm."""
    few, more = _few(u, min(most, DIRECT)), np.arange(DIRECT + 1, most + 1)
    if not len(more):
        return np.maximum.accumulate(few, axis=1)
    rest = np.empty((len(u), len(more)))
    at_once = max(1, 200_000 // len(more))
    for i in range(0, len(u), at_once):
        part = np.repeat(u[i : i + at_once], len(more))
        j = np.tile(more, len(part) // len(more))
        # roots lie within 12 deviations of the mean
        low, high = np.log(np.maximum(1.0, j - 12 * np.sqrt(j))), np.log(j + 60.0 + 12 * np.sqrt(j))
        for _ in range(56):
            mid = (low + high) / 2
            above = _below(j, np.exp(mid)) > part
            low, high = np.where(above, mid, low), np.where(above, high, mid)
        rest[i : i + at_once] = np.exp((low + high) / 2).reshape(-1, len(more))
    return np.maximum.accumulate(np.concatenate([few, rest], axis=1), axis=1)


def _staged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64()), ("means", pa.list_(pa.float64()))])
    for batch in batches:
        most = np.asarray(batch.column("most")).astype(np.int64)
        u, lists = np.asarray(batch.column("u")), np.empty(batch.num_rows, object)
        for k in np.unique(most):
            at = np.flatnonzero(most == k)
            for i, row in zip(at, means(u[at], int(k)), strict=True):
                lists[i] = row
        flat = np.concatenate(lists) if len(lists) else np.zeros(0)
        offsets = pa.array(np.concatenate([[0], np.cumsum(most)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("tokens"), pa.ListArray.from_arrays(offsets, pa.array(flat))], schema=schema)


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("most")).limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    if any(r["most"] > REPEATS for r in rows):
        raise ValueError(f"more than {REPEATS} repeats")
    return {r["source"]: (float(r["share"]), int(r["most"])) for r in rows}


def _nearest(bins: DataFrame, wanted: dict[str, float]) -> dict[str, tuple[float, float, float]]:
    """For each source, from (source, bin, tokens): the last bin whose running total stays within the target, that total, and the total with the next."""
    order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    goal = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv))[F.col("source")]
    running = bins.withColumn("total", F.sum("tokens").over(order)).withColumn("inside", F.col("total") <= goal)
    rows = running.groupBy("source").agg(F.max(F.when(F.col("inside"), F.col("bin"))).alias("bin"), F.max(F.when(F.col("inside"), F.col("total"))).alias("total"), F.min(F.when(~F.col("inside"), F.col("bin"))).alias("next"), F.min(F.when(~F.col("inside"), F.col("total"))).alias("after")).collect()
    return {r["source"]: r for r in rows}


def mix(spark: SparkSession, sized: DataFrame, targets: DataFrame, seed: int = 17, fill: float = FILL) -> DataFrame:
    """(doc_id, source, tokens, repeats) of the chosen documents.

    ``sized`` has (doc_id, source, tokens). Documents of null or untargeted sources, and without tokens, are never chosen. The size of the mix is
    ``fill`` of the largest that no source's documents and repeats limit. Sources with a target but no documents are left out of it, and the others' shares are scaled.
    """
    goals = _targets(targets)
    if not goals:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, repeats int")
    most = F.create_map(*(F.lit(x) for s, (_, m) in goals.items() for x in (s, m)))[F.col("source")]
    staged = sized.where(F.col("source").isin(*goals) & (F.col("tokens") > 0)).select("doc_id", "source", "tokens", most.alias("most"), uniform("doc_id", "source", "tokens", seed=seed).alias("u"))
    staged = cut(staged.mapInArrow(_staged, "doc_id bigint, source string, tokens bigint, means array<double>"))
    there = {r["source"]: r["n"] for r in staged.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    goals = {s: g for s, g in goals.items() if there.get(s)}
    if not goals:
        return spark.createDataFrame([], "doc_id bigint, source string, tokens bigint, repeats int")
    total = fill * min(there[s] * m / share for s, (share, m) in goals.items())
    wanted = {s: total * share for s, (share, _) in goals.items()}
    # the logarithm of the mean, first between -60 and 8, then within the bin that the target falls into
    low, width = dict.fromkeys(goals, -60.0), dict.fromkeys(goals, 68.0 / STEPS)
    before: dict[str, float] = dict.fromkeys(goals, 0.0)
    mean = {}
    for last in (False, True):
        edge = F.create_map(*(F.lit(x) for kv in low.items() for x in kv))[F.col("source")]
        step = F.create_map(*(F.lit(x) for kv in width.items() for x in kv))[F.col("source")]
        bins = staged.select("source", "tokens", F.explode("means").alias("mean")).withColumn("bin", F.floor((F.log("mean") - edge) / step).cast("int")).where(f"bin >= 0 and bin < {STEPS}")
        bins = bins.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"))
        found = _nearest(bins, {s: wanted[s] - before[s] for s in goals})
        for s in goals:
            r = found.get(s)
            inside, after = (r["total"] or 0.0, r["after"]) if r else (0.0, None)
            if not last:
                # the target lies in the next bin that has documents, or beyond all
                at = r["next"] if r and r["next"] is not None else STEPS - 1
                before[s] += inside
                low[s], width[s] = low[s] + at * width[s], width[s] / STEPS
            else:
                left = wanted[s] - before[s]
                over = after is not None and after - left < left - inside
                at = r["next"] if over else (r["bin"] if r and r["bin"] is not None else -1)
                mean[s] = low[s] + (at + 1) * width[s]
    upto = F.create_map(*(F.lit(x) for kv in mean.items() for x in kv))[F.col("source")]
    chosen = staged.where(F.col("source").isin(*goals)).withColumn("repeats", F.size(F.filter("means", lambda m: F.log(m) < upto)))
    return chosen.where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def shuffled(chosen: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, tokens, copy, place): a row for each copy, in a global random order given by ``place``."""
    rows = chosen.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy"))
    return rows.withColumn("place", uniform("doc_id", "copy", "source", seed=seed + 1)).orderBy("place")


def shares(chosen: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source, the null one and untargeted ones included: documents, copies, tokens of the mix, target and actual share."""
    own = chosen.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("repeats").alias("n_copies"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.max("repeats").alias("most"))
    every = sized.select("source").distinct()
    goal = targets.where("source is not null").groupBy(F.col("source").alias("s")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = every.join(goal, F.col("source") == F.col("s"), "left").drop("s").join(own.withColumnRenamed("source", "o"), F.col("source") == F.col("o"), "left")
    whole = chosen.agg(F.sum(F.col("tokens") * F.col("repeats")).alias("whole"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.crossJoin(F.broadcast(whole)).select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)).alias("actual_share"), zero("n_docs"), zero("n_copies"), zero("tokens"), zero("most").alias("most_repeats"), "max_repeats")


def checked(chosen: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """What must hold, per source with a target: ``share_met`` (to within the largest document of any source) and ``repeats_kept``."""
    found = shares(chosen, sized, targets)
    sizes = sized.agg(F.max("tokens").alias("largest")).crossJoin(F.broadcast(chosen.agg(F.sum(F.col("tokens") * F.col("repeats")).alias("whole"))))
    rows = found.where("target_share > 0").crossJoin(F.broadcast(sizes))
    met = F.abs(F.col("actual_share") - F.col("target_share")) * F.col("whole") <= F.col("largest")
    return rows.select("source", F.round("target_share", 6).alias("target_share"), met.alias("share_met"), (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"))
