"""From steps to a model: merging, normalising, bias, norms, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aggregate_steps(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pattern, total): twice the sum of the deltas of a pattern. Null deltas and patterns are left out."""
    return steps.where("delta is not null and pattern is not null").groupBy(*keys, "pattern").agg((2 * F.sum("delta")).alias("total"))


def _sizes(steps: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return steps.where("delta is not null and pattern is not null").groupBy(*keys).agg(F.sum(F.abs("delta")).alias("l1"), F.sum("delta").alias("sum"))


def normalise(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pattern, weight): totals over the sum of absolute deltas of all lines; null where that is 0."""
    totals, sizes = aggregate_steps(steps, keys), _sizes(steps, keys).drop("sum")
    joined = totals.join(sizes, list(keys)) if keys else totals.crossJoin(F.broadcast(sizes))
    return joined.select(*keys, "pattern", F.try_divide("total", "l1").alias("weight"))


def bias(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bias): minus the sum of deltas over the sum of their sizes."""
    return _sizes(steps, keys).select(*keys, F.try_divide(-F.col("sum"), F.col("l1")).alias("bias"))


def norms(steps: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, l1, l2): sizes of all lines summed, and the length of the vector of totals."""
    l2 = aggregate_steps(steps, keys).groupBy(*keys).agg(F.sqrt(F.sum(F.col("total") * F.col("total"))).alias("l2"))
    l1 = _sizes(steps, keys).drop("sum")
    return l1.join(l2, list(keys)) if keys else l1.crossJoin(F.broadcast(l2))


def with_ids(model: DataFrame, keys: tuple[str, ...] = (), separator: str = " ") -> DataFrame:
    """(keys, feature_id, pattern, tokens, weight): ids are ranks of patterns in byte order. One model is one window; models are small."""
    order = Window.partitionBy(*keys).orderBy("pattern")
    tokens = F.split("pattern", separator) if separator else F.filter(F.split("pattern", ""), lambda x: x != "")
    return model.select(*keys, (F.row_number().over(order) - 1).alias("feature_id"), "pattern", tokens.alias("tokens"), "weight")


def make_model(steps: DataFrame, keys: tuple[str, ...] = (), separator: str = " ") -> DataFrame:
    """The final model of recorded steps."""
    return with_ids(normalise(steps, keys), keys, separator)
