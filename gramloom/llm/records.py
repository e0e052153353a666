"""Reading dirty two-field records: exchanging fields, canonical forms, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INTEGER = r"\A[\s\u00A0\u200B]*[+-]?[0-9]{1,18}[\s\u00A0\u200B]*\z"
_OUTER = r"[\s\u00A0\u200B]+"


def is_integer(text: Column) -> Column:
    """Whether a text is an integer of up to 18 digits, outer white space aside; false for null."""
    return F.coalesce(text.rlike(_INTEGER), F.lit(False))


def exchanged(records: DataFrame, label: str = "class_label", sequence: str = "example_sequence") -> DataFrame:
    """Both fields in their places: exchanged where the label is no integer and the sequence is one.

    A null label is no integer, but is left where it is, unless the sequence is an integer.
    """
    swap = ~is_integer(F.col(label)) & is_integer(F.col(sequence))
    return records.withColumns({label: F.when(swap, F.col(sequence)).otherwise(F.col(label)), sequence: F.when(swap, F.col(label)).otherwise(F.col(sequence))})


def letters_digits(text: Column) -> Column:
    """Only the letters and digits of a text, in lower case; null for null."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", ""))


def canonical_key(label: Column, sequence: Column) -> Column:
    """16 bytes that agree for records with equal labels (as integers) and sequences (letters and digits).

    Null equals only null, in either field. A label that is no integer counts as its text without outer white space.
    """
    number = F.regexp_replace(label, _OUTER, "").try_cast("bigint").cast("string")
    plain = F.when(label.isNull(), F.lit("n")).when(is_integer(label), F.concat(F.lit("i"), number)).otherwise(F.concat(F.lit("t"), F.trim(label)))
    body = F.when(sequence.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), letters_digits(sequence)))
    return F.substring(F.unhex(F.sha2(F.concat(plain, F.lit("\x1f"), body), 256)), 1, 16)


def with_groups(rows: DataFrame, groups: DataFrame, count: str, key: str = "key", share: float = 0.001, least: int = 1_000) -> DataFrame:
    """``rows`` joined with the groups that they belong to by ``key``; ``groups`` has ``count``, the rows of each.

    Keys of more than ``share`` of all rows, and of more than ``least``, would overload a task. They are fewer than 1 / ``share``, and only their groups are broadcast; all other
    keys go through a shuffled join.
    """
    total = groups.agg(F.sum(count).alias("__all"))
    marked = groups.crossJoin(F.broadcast(total)).withColumn("__hot", (F.col(count) > share * F.col("__all")) & (F.col(count) > least)).drop("__all")
    hot, light = marked.where("__hot").drop("__hot"), marked.where("not __hot").drop("__hot")
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(light, key)
    return near.unionByName(far)
