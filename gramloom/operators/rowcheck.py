r"""Separating rows that fail to parse from valid ones, with the reason of each failure.

A :class:`RowSchema` names the fields of a line in order. From it one anchored
pattern for the whole row is generated. Rows that match are valid and go no
further. The others pass through patterns that cover one field more at a time, and the
first that does not match names the broken field.

Only two-field lines ``label<blank or tab>sequence`` are needed here, in a char and
a word form. All patterns are linear (no nested repeats), so very long lines are safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a doubled quote inside a quoted sequence while patterns are tested.
DOUBLED = "\uE000"


@dataclass(frozen=True)
class Step:
    """One field more of the row: the reason given if ``pattern``, after all before it, does not match."""

    reason: str
    pattern: str


@dataclass(frozen=True)
class RowSchema:
    """A line format. ``whole`` matches valid rows; ``prefixes`` are tried in order on the others."""

    name: str
    label: str
    sequences: tuple[str, ...]
    quoting: str
    shape: str
    labels: str = r"(?:\+1|1|-1)"

    @property
    def whole(self) -> str:
        """The anchored pattern of a valid row."""
        return rf"\A{self.labels}{SEP}(?:{'|'.join(self.sequences)})[ \t]*\z"

    @property
    def prefixes(self) -> tuple[Step, ...]:
        """Anchored patterns, each covering a further property of the row, in the order of their reasons."""
        return (
            Step("columns", rf"\A{self.label}{SEP}[ \t]*[^ \t]"),
            Step("quoting", rf"\A{self.label}{SEP}(?:{self.quoting})\z"),
            Step("columns", rf"\A{self.label}{SEP}(?:{self.shape})[ \t]*\z"),
            Step("label", rf"\A{self.labels}{SEP}"),
            Step("sequence", self.whole),
        )


SEP = r"[ \t]"
_BAD = r"\x00-\x08\x0A-\x1F\x7F�"

CHAR = RowSchema(
    name="char",
    label=r"[^ \t]+",
    sequences=(r"[A-Za-z]+",),
    quoting=r'[^"]*',
    shape=r"[^ \t]+",
)

WORD = RowSchema(
    name="word",
    label=r"[^ \t]+",
    sequences=(
        rf'[^"\t{_BAD}]*[^" \t{_BAD}]',
        rf'"[^"{_BAD}]*[^" \t{_BAD}][^"{_BAD}]*"',
    ),
    quoting=r'[^"]*|"[^"]*"[ \t]*|"[^"]*"\t[^"]*',
    shape=r'[^"\t]*[^" \t]|"[^"]*"',
)


def _row(raw: Column) -> Column:
    """The line without one closing carriage return, doubled quotes of a quoted sequence replaced by one mark."""
    line = F.regexp_replace(raw, r"\r\z", "")
    head = F.regexp_extract(line, r'\A([^ \t]*[ \t]")', 1)
    rest = F.substring(line, F.length(head) + 1, F.length(line))
    return F.when(head != "", F.concat(head, F.replace(rest, F.lit('""'), F.lit(DOUBLED)))).otherwise(line)


def check_rows(lines: DataFrame, raw: str = "raw_line", kind: str = "token_type") -> DataFrame:
    """Every record line with its parse, or with the reason it has none.

    Adds ``class_label`` (int), ``example_sequence`` and ``reason`` to the columns of ``lines``;
    for valid rows the reason is null, for the others both fields are. Lines that are null, hold nothing but
    blanks, tabs and carriage returns, or start with ``;`` are neither records nor failures and are
    left out. A ``kind`` that is not ``char`` (null, too) is read as word. Columns of ``lines`` with
    the three added names are replaced. Repeated rows stay repeated.
    """
    text, char = F.col("__row"), F.coalesce(F.col(kind) == "char", F.lit(False))
    frame = lines.where(F.col(raw).isNotNull() & ~F.col(raw).rlike(r"\A(?:[ \t\r]*\z|;)")).withColumn("__row", _row(F.col(raw)))
    whole = F.when(char, text.rlike(CHAR.whole)).otherwise(text.rlike(WORD.whole))
    chain = None
    for c, w in zip(CHAR.prefixes, WORD.prefixes, strict=True):
        bad = ~F.when(char, text.rlike(c.pattern)).otherwise(text.rlike(w.pattern))
        chain = F.when(bad, c.reason) if chain is None else chain.when(bad, c.reason)
    sequence = F.regexp_replace(F.regexp_replace(text, r"\A[^ \t]*[ \t]", ""), r"[ \t]+\z", "")
    inner = F.when(sequence.startswith('"'), F.replace(F.substring(sequence, F.lit(2), F.length(sequence) - 2), F.lit(DOUBLED), F.lit('"'))).otherwise(sequence)
    return (
        frame.withColumn("reason", F.when(whole, F.lit(None).cast("string")).otherwise(chain))
        .withColumn("class_label", F.when(F.col("reason").isNull(), F.regexp_extract(text, r"\A([^ \t]*)", 1).try_cast("int")))
        .withColumn("example_sequence", F.when(F.col("reason").isNull(), inner))
        .drop("__row")
    )


def failed_rows(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """Distinct (key, reason) of the rows that fail. Only these two narrow columns are shuffled."""
    return check_rows(lines).where(F.col("reason").isNotNull()).select(key, "reason").distinct()


def valid_rows(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """The valid records: key, ``class_label``, ``example_sequence``; a key delivered twice once."""
    return check_rows(lines).where(F.col("reason").isNull()).select(key, "class_label", "example_sequence").dropDuplicates([key])
