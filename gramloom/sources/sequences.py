"""Labelled sequences: ``label<blank or tab>text`` lines, and tables that hold both fields."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a sequence file as ``value``, without length limit."""
    return spark.read.text(path)


def stored_lines(spark: SparkSession, lines: Iterable[str], path: str, at_once: int = 100_000) -> DataFrame:
    """(line_no, value) of a stream of lines, written to ``path`` a bounded number at a time."""
    schema, n, left = "line_no bigint, value string", 0, iter(lines)
    while True:
        part = [(n + i, x.rstrip("\n")) for i, x in enumerate(islice(left, at_once))]
        if part or not n:
            spark.createDataFrame(part, schema).write.mode("append").parquet(path)
        n += len(part)
        if len(part) < at_once:
            return spark.read.schema(schema).parquet(path)


def lines_of(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Lines that a program already holds (from its standard input, say) as ``value``."""
    return spark.createDataFrame([(x,) for x in lines], "value string")


def record_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines without one trailing carriage return; null and empty lines and those starting with ``;`` are skipped."""
    text = F.regexp_replace(F.col(value), r"\r\z", "")
    return lines.withColumn(value, text).where(F.col(value).isNotNull() & (F.col(value) != "") & ~F.col(value).startswith(";"))


def split_first(value: Column) -> tuple[Column, Column]:
    """What stands before and after the first blank or tab; the second is null where there is none."""
    parts = F.split(value, "[\\t ]", 2)
    return parts.getItem(0), F.get(parts, F.lit(1))


def starts_positive(label: Column) -> Column:
    """Whether the number that a label starts with, after white space, is above 0, of however many digits; false where it starts with none (null for null)."""
    return label.rlike(r"^\s*\+?0*[1-9]")


def parse_labelled(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``class_label``, ``y`` (1 or -1) and ``text``. Lines without a delimiter are rejected: they have no text.

    Labels above 0 are positive, all others (0, too) negative.
    """
    label, text = split_first(F.col(value))
    out = record_lines(lines, value).withColumns({"class_label": label, "text": text}).where(F.col("text").isNotNull())
    return out.withColumn("y", F.when(starts_positive(F.col("class_label")), 1).otherwise(-1))


def labelled_docs(table: DataFrame, token_type: str | None = None, key: str = "doc_id") -> DataFrame:
    """(doc_id, split_name, source, token_type, y, text) of the rows with a whole integer label and a text, each id once.

    Rows with a null id, another label or a null text are left out; 0 counts as negative.
    """
    rows = table.where(F.col(key).isNotNull() & F.col("example_sequence").isNotNull() & F.col("class_label").rlike(r"^\s*[+-]?[0-9]+\s*$"))
    if token_type is not None:
        rows = rows.where(F.col("token_type") == token_type)
    y = F.when(starts_positive(F.col("class_label")), 1).otherwise(-1)
    return rows.select(F.col(key).alias("doc_id"), "split_name", "source", "token_type", y.alias("y"), F.col("example_sequence").alias("text")).dropDuplicates(["doc_id"])


def class_counts(docs: DataFrame) -> DataFrame:
    """One row: ``n_docs``, ``n_positive``, ``n_negative``."""
    return docs.agg(F.count("*").alias("n_docs"), F.count_if(F.col("y") > 0).alias("n_positive"), F.count_if(F.col("y") <= 0).alias("n_negative"))
