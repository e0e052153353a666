"""The one-pass classifier as a stream: stateless scoring of arriving documents, metrics per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gramloom.functions.tokens import tokenised
from gramloom.operators import evaluate, matcher
from gramloom.sources.sequences import parse_labelled


def labelled_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(class_label, y, text) of the lines of files that arrive in a folder. Comment and blank lines, and lines without a delimiter, are skipped."""
    return parse_labelled(spark.readStream.text(folder)).drop("value")


def score_stream(stream: DataFrame, model: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], kind: str = "word", threshold: float = 0.0) -> DataStreamWriter:
    """A writer that scores each micro-batch and hands ``sink`` the scored documents, a report row, and the batch's number.

    Every document of a batch gets an id there; scores depend on the document alone, so a batch that is run again gives the same rows.
    """

    def each(batch: DataFrame, number: int) -> None:
        docs = tokenised(batch.withColumn("doc_id", F.monotonically_increasing_id()), kind).persist()
        found = matcher.matches(docs, model)
        scored = docs.select("doc_id", "y", "text").join(matcher.scores(docs, found, threshold=threshold), "doc_id")
        sink(scored, evaluate.report(scored), number)
        docs.unpersist()

    return stream.writeStream.foreachBatch(each)
