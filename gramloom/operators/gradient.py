"""Gradients of patterns, their bounds, pruning, and the best pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.functions.losses import LOGISTIC, penalty_slope, slope


def gradients(pairs: DataFrame, state: DataFrame, objective: int = LOGISTIC, small_state: bool = False) -> DataFrame:
    """(pattern, size, support, gradient, upos, uneg).

    ``pairs`` has distinct (pattern, size, doc_id), ``state`` (doc_id, y, score). ``upos`` and ``uneg`` are the parts of positive and
    negative documents: no extension of a pattern can have a gradient outside of what they span. Partial sums are combined
    before the shuffle. ``small_state`` says that the state's size was checked and may be broadcast.
    """
    own = state.select("doc_id", "y", slope(F.col("y"), F.col("score"), objective).alias("g"))
    joined = pairs.join(F.broadcast(own) if small_state else own, "doc_id")
    zero = F.lit(0.0)
    return joined.groupBy("pattern", "size").agg(F.count("*").alias("support"), F.sum("g").alias("gradient"), F.sum(F.when(F.col("y") > 0, F.col("g")).otherwise(zero)).alias("upos"), F.sum(F.when(F.col("y") <= 0, F.col("g")).otherwise(zero)).alias("uneg"))


def regularised(grads: DataFrame, coef: DataFrame, cost: float = 1.0, alpha: float = 0.2) -> DataFrame:
    """Adds the penalty's slope to the gradients of patterns in the model. ``coef`` has (pattern, beta)."""
    joined = grads.join(coef.select("pattern", "beta"), "pattern", "left")
    return joined.withColumn("gradient", F.col("gradient") + F.coalesce(penalty_slope(F.col("beta"), cost, alpha), F.lit(0.0))).drop("beta")


def prefix_bounds(grads: DataFrame, coef: DataFrame, cost: float = 1.0, alpha: float = 0.2) -> DataFrame:
    """Adds ``bound``: the largest size of gradient that the pattern or an extension of it can have.

    The plain bound holds for extensions outside the model; those inside it, of which the pattern is a prefix, shift both parts
    by their penalty's slope. The model is exploded to its prefixes, so this is an equi-join.
    """
    prefixes = coef.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("pattern")), lambda n: F.slice("pattern", F.lit(1), n))).alias("pattern"), penalty_slope(F.col("beta"), cost, alpha).alias("shift"))
    spans = prefixes.groupBy("pattern").agg(F.min("shift").alias("low"), F.max("shift").alias("high"))
    joined = grads.join(spans, "pattern", "left")
    low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(0.0))
    bound = F.greatest(F.abs("upos"), F.abs("uneg"), F.abs(F.col("upos") + low), F.abs(F.col("upos") + high), F.abs(F.col("uneg") + low), F.abs(F.col("uneg") + high))
    return joined.withColumn("bound", bound).drop("low", "high")


def survivors(bounded: DataFrame, tau: float, minsup: int = 1) -> DataFrame:
    """The patterns worth extending: support of ``minsup`` or more and a bound above the best gradient so far."""
    return bounded.where((F.col("support") >= minsup) & (F.col("bound") > tau))


def best(grads: DataFrame, minpat: int = 1, breadth: bool = True, digits: int = 12) -> DataFrame:
    """The one row of largest absolute gradient; ties go to the pattern that the search visits first.

    Gradients are compared to ``digits`` decimals, as sums over shuffled rows differ in the last bits. A top-1, not a sort.
    """
    visit = [F.col("size"), F.col("pattern")] if breadth else [F.col("pattern")]
    # a last element that is a wildcard never makes a pattern of its own
    return grads.where((F.col("size") >= minpat) & (F.element_at("pattern", -1) != "*")).orderBy(F.round(F.abs("gradient"), digits).desc(), *visit).limit(1)
