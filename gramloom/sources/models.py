"""Models as files: steps as text (``delta pattern`` lines) or Parquet, predictors as text, models and reports as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gramloom.sources.sequences import split_first


# Texts of the per-document reports.
NO_MATCH, BIAS, BLOCK = "Test doc out of vocabulary", "__DFAULT__", ("<instance>", "</instance>")


def write_steps(steps: DataFrame, path: str, by: str | None = None) -> None:
    """``delta`` with 12 decimals and the pattern, a line for each step in order. With ``by``, each of its values has a folder, so that many models are written by many tasks."""
    line = F.concat_ws(" ", F.format_string("%.12f", F.col("delta")), F.col("pattern")).alias("value")
    if by:
        steps.repartition(by).sortWithinPartitions(by, "step").select(by, line).write.mode("overwrite").partitionBy(by).text(path)
    else:
        steps.orderBy("step").select(line).coalesce(1).write.mode("overwrite").text(path)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """(delta, pattern) of steps, repeats included, and the column that they were written by, if any; lines may be of any length."""
    delta, pattern = split_first(F.col("value"))
    lines = spark.read.text(path)
    others = [c for c in lines.columns if c != "value"]
    return lines.withColumn("value", F.regexp_replace("value", r"\r\z", "")).where("value <> ''").select(*others, delta.try_cast("double").alias("delta"), pattern.alias("pattern")).where("delta is not null and pattern is not null")


def predictor_lines(model: DataFrame, bias: float) -> DataFrame:
    """Lines of a predictors file: the bias, then ``weight pattern`` by falling weight (ties by pattern)."""
    spark = model.sparkSession
    head = spark.createDataFrame([(0, bias, "")], "part int, weight double, pattern string")
    rows = head.unionByName(model.select(F.lit(1).alias("part"), "weight", "pattern"))
    return rows.orderBy("part", F.desc("weight"), "pattern").select(F.rtrim(F.concat_ws(" ", F.col("weight").cast("string"), F.col("pattern"))).alias("value"))


def write_model(model: DataFrame, path: str) -> None:
    """(feature_id, pattern, tokens, weight) as Parquet."""
    model.write.mode("overwrite").parquet(path)


def write_bias(spark: SparkSession, bias: float | None, path: str) -> None:
    """The bias of a model, beside it."""
    spark.createDataFrame([(bias,)], "bias double").coalesce(1).write.mode("overwrite").parquet(f"{path}/_bias")


def read_bias(spark: SparkSession, path: str) -> float:
    """The bias written beside a model; 0 where there is none."""
    try:
        return spark.read.schema("bias double").parquet(f"{path}/_bias").first()["bias"] or 0.0
    except AnalysisException:
        return 0.0


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """A model written by :func:`write_model`."""
    return spark.read.parquet(path)


def score_lines(scored: DataFrame, verbosity: int = 1, bias: float = 0.0) -> DataFrame:
    """Lines (doc_id, value) per document, which for 4 have line breaks.

    1 ``y score prob``; 2 with the text; 3 a message for documents without a match, no others; 4 a block of the line with the text, the bias and the
    rules (``rules``: (pattern, weight) in order), a line each; 5 ``y`` and the ids of the matched patterns (``features``).
    """
    line = [F.col("y").cast("string"), F.col("score").cast("string"), F.col("prob").cast("string")]
    if verbosity == 3:
        return scored.where("n_matched = 0").select("doc_id", F.lit(NO_MATCH).alias("value"))
    if verbosity == 4:
        rules = F.transform(F.coalesce("rules", F.array().cast("array<struct<pattern: string, weight: double>>")), lambda r: F.concat_ws(" ", F.lit("rule:"), r["pattern"], r["weight"].cast("string")))
        block = F.concat(F.array(F.lit(BLOCK[0]), F.concat_ws(" ", *line, "text"), F.lit(f"rule: {bias!r} {BIAS}")), rules, F.array(F.lit(BLOCK[1])))
        return scored.select("doc_id", F.array_join(block, "\n").alias("value"))
    parts = {1: line, 2: [*line, "text"], 5: [line[0], "features"]}[verbosity]
    return scored.select("doc_id", F.concat_ws(" ", *parts).alias("value"))
