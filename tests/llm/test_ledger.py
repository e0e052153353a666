import datetime as dt
import subprocess
import sys
from collections import Counter

import pytest

from gramloom.llm import ledger

SCHEMA = "doc_id long, class_label string, example_sequence string, loaded_at timestamp"
T = [dt.datetime(2025, 1, d) for d in range(1, 20)]


def found(spark, rows, batches=3):
    own, kept = ledger.deduplicate(spark, spark.createDataFrame(rows, SCHEMA), batches)
    return sorted(tuple(r) for r in ledger.copies(own, kept).collect()), sorted((r["first_id"], r["copies"]) for r in kept.collect())


def test_groups(spark):
    rows = [
        (1, "+1", "Ab c-1", T[0]), (2, "1 ", "abc1", T[5]), (3, " 1", "A.B.C.1\n", T[9]), (4, "abc1", "+1", T[3]),
        (5, "-1", "abc1", T[1]), (6, None, "abc1", T[1]), (7, None, "ABC1", T[8]), (8, "0", None, T[1]), (9, "0", None, T[1]), (10, "0", "", T[1]), (11, "0", "--", T[2]),
        (12, "1", "Naïve é", T[2]), (13, "1", "NAÏVEÉ", None), (1, "+1", "Ab c-1", T[12]), (None, "1", "abc1", T[1]), (14, "12345678901234567890", "q", T[1]), (15, "12345678901234567890", "q", T[1]),
    ]
    copies, counts = found(spark, rows)
    assert copies == [(1, 2), (1, 3), (1, 4), (6, 7), (8, 9), (10, 11), (12, 13), (14, 15)]
    assert dict(counts) == {1: 4, 5: 1, 6: 2, 8: 2, 10: 2, 12: 2, 14: 2}


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_batches_do_not_matter(spark, batches):
    rows = [(i, str(i % 2), "x" * (i % 3), T[(i * 7) % 19]) for i in range(1, 60)]
    groups = Counter()
    first = {}
    for i, label, text, _ in rows:
        groups[label, text] += 1
        first.setdefault((label, text), i)
    copies, counts = found(spark, rows, batches)
    assert counts == sorted((first[k], n) for k, n in groups.items())
    assert copies == sorted((first[label, text], i) for i, label, text, _ in rows if first[label, text] != i)


def test_a_hot_key_is_split_off(spark):
    rows = [(i, "1", "hot", T[0]) for i in range(1, 1500)] + [(i, "1", f"cold{i // 2}", T[1]) for i in range(1500, 1600)]
    copies, _ = found(spark, rows)
    assert len(copies) == 1498 + 50 and all(a < b for a, b in copies)


def test_empty_and_equal_times(spark):
    assert found(spark, []) == ([], [])
    assert found(spark, [(1, "1", "a", None), (2, "1", "a", None)]) == ([(1, 2)], [(1, 2)])
    assert found(spark, [(2, "1", "a", T[0]), (1, "1", "a", T[0])]) == ([(1, 2)], [(1, 2)])


def counts(one):
    return sorted((r["first_id"], r["copies"]) for r in one.counts().collect())


def test_a_ledger_lasts(spark, tmp_path):
    keyed = lambda rows: ledger.keyed(spark.createDataFrame(rows, SCHEMA)).select("id", "key")
    path = f"file://{tmp_path}/ledger"
    one = ledger.Ledger(spark, path, 4)
    assert one.apply(keyed([(5, "1", "a", T[0]), (6, "1", "b", T[0]), (7, "1", "A.", T[0])])) == 1
    # another program opens it; ids 5 and 6 are delivered again, 5 twice
    two = ledger.Ledger(spark, path, 99)
    assert two.n == 1 and two.buckets == 4
    assert two.apply(keyed([(5, "1", "a", T[3]), (6, "1", "b", T[3]), (5, "1", "a", T[4]), (2, "1", "a", T[4])])) == 2
    assert counts(two) == counts(ledger.Ledger(spark, path)) == [(2, 3), (6, 1)]
    # nothing new changes nothing, and a batch that was written but has no state isn't there
    assert two.apply(keyed([(2, "1", "a", T[5])])) == 3 and counts(two) == [(2, 3), (6, 1)]
    spark.createDataFrame([(0, b"x", 9, 9)], ledger.LEDGER).write.partitionBy("bucket").parquet(f"{path}/counts/4")
    again = ledger.Ledger(spark, path)
    assert counts(again) == [(2, 3), (6, 1)] and again.apply(keyed([(9, "1", "c", T[6])])) == 4
    assert counts(ledger.Ledger(spark, path)) == [(2, 3), (6, 1), (9, 1)]


def test_a_ledger_in_another_process(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    code = f"""
import sys; sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
from gramloom.llm import ledger
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
ledger.Ledger(spark, {path!r}, 2).apply(spark.createDataFrame([(1, b"a"), (2, b"a"), (3, b"b")], "id long, key binary"))
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    one = ledger.Ledger(spark, path)
    one.apply(spark.createDataFrame([(2, b"a"), (4, b"b"), (2, b"a")], "id long, key binary"))
    assert counts(one) == [(1, 2), (3, 2)]


def test_buckets_grow_with_the_records():
    assert [ledger.buckets_for(n) for n in (0, 10**6, 17 * 10**6, 3 * 10**9)] == [16, 16, 32, 4096]
