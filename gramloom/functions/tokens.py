"""Tokenisers as column expressions. Char tokens are code points, word tokens stand between white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The words of a text; none for an empty or blank text, null for null."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def chars(text: Column) -> Column:
    """One token for each character; white space at the end is dropped, elsewhere it must not stand: see :func:`is_char_text`."""
    return F.filter(F.split(F.regexp_replace(text, r"\s+$", ""), ""), lambda x: x != "")


def is_char_text(text: Column) -> Column:
    """Whether a text is a char sequence: no white space before its last character."""
    return ~F.regexp_replace(text, r"\s+$", "").rlike(r"\s")


def chars_no_space(text: Column) -> Column:
    """One token for each character that isn't white space."""
    return F.filter(F.split(F.regexp_replace(text, r"\s", ""), ""), lambda x: x != "")


def tokenised(docs: DataFrame, kind: str = "word") -> DataFrame:
    """Adds ``tokens`` of ``text``: ``word``, ``char`` (spaces dropped) or ``char_strict`` (a space inside is an error)."""
    text = F.col("text")
    if kind == "word":
        return docs.withColumn("tokens", words(text))
    if kind == "char":
        return docs.withColumn("tokens", chars_no_space(text))
    bad = F.raise_error(F.concat(F.lit("white space inside a char sequence: "), F.left(text, F.lit(80)))).cast("array<string>")
    return docs.withColumn("tokens", F.when(text.isNull(), F.lit(None)).when(is_char_text(text), chars(text)).otherwise(bad))


def shown(pattern: Column, kind: str = "word") -> Column:
    """A pattern's tokens as text."""
    return F.array_join(pattern, " " if kind == "word" else "")
