import pytest

from gramloom.operators.rowcheck import check_rows, failed_rows, valid_rows

SCHEMA = "line_id long, token_type string, raw_line string"

CASES = [
    ("char", "+1 abc", None, 1, "abc"),
    ("char", "-1\tabc \t\r", None, -1, "abc"),
    ("word", "1 a b  c ", None, 1, "a b  c"),
    ("word", '1 "a ""b"" c"', None, 1, 'a "b" c'),
    ("word", '1 "a\tb"', None, 1, "a\tb"),
    ("word", "1  a", None, 1, " a"),
    ("char", "abc", "columns", None, None),
    ("char", " abc", "columns", None, None),
    ("char", "+1  ", "columns", None, None),
    ("char", '1 ab"c', "quoting", None, None),
    ("char", '1 "abc"', "quoting", None, None),
    ("word", '1 a "b" c', "quoting", None, None),
    ("word", '1 "a "b" c"', "quoting", None, None),
    ("word", '1 "a', "quoting", None, None),
    ("word", '1 "a" b', "quoting", None, None),
    ("word", '1 "a"\tb"', "quoting", None, None),
    ("word", '1 "a"\tb', "columns", None, None),
    ("word", "1 a\tb", "columns", None, None),
    ("char", "1 ab cd", "columns", None, None),
    ("char", "x ab cd", "columns", None, None),
    ("char", "+2 abc", "label", None, None),
    ("char", "+1x ab1", "label", None, None),
    ("char", "1 ab1", "sequence", None, None),
    ("char", "1 abé", "sequence", None, None),
    ("word", '1 ""', "sequence", None, None),
    ("word", '1 " \t "', "sequence", None, None),
    ("word", "1 a\x01", "sequence", None, None),
    ("word", "1 a\x7f", "sequence", None, None),
    ("word", "1 a�", "sequence", None, None),
    ("word", "1 a\rb", "sequence", None, None),
    (None, "1 a b", None, 1, "a b"),
]


def test_reasons_and_records(spark):
    rows = [(i, k, line) for i, (k, line, *_) in enumerate(CASES)]
    got = {r["line_id"]: (r["reason"], r["class_label"], r["example_sequence"]) for r in check_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (_, line, *want) in enumerate(CASES):
        assert got[i] == tuple(want), line


def test_neither_records_nor_failures(spark):
    rows = [(i, "word", x) for i, x in enumerate([None, "", " \t\r", ";1 a", "\r"])]
    assert check_rows(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert failed_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_and_clashing_columns(spark):
    lines = spark.createDataFrame([(1, "char", "x", "mine"), (1, "char", "x", "mine"), (2, "char", "1 a", "mine"), (2, "char", "1 a", "mine")], SCHEMA + ", reason string")
    assert failed_rows(lines).collect() == [(1, "columns")]
    assert valid_rows(lines).collect() == [(2, 1, "a")]


@pytest.mark.parametrize("n", [200_000])
def test_very_long_lines(spark, n):
    rows = [(1, "word", '1 "' + 'a"" ' * n + '"'), (2, "char", "1 " + "a" * n), (3, "word", "1 " + "a " * n + "\x01")]
    got = {r["line_id"]: r["reason"] for r in check_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: None, 2: None, 3: "sequence"}
