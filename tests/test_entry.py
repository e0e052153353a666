import os

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from gramloom import tables
from gramloom.plans import loading, reference

CORE = {**loading.QUERIES, **reference.QUERIES}


def test_every_query_has_its_sql():
    rows_only = {"learn_word", "learn_char", "learn_log"}
    assert set(CORE) - set(entry.oracle_sql()) == rows_only
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["pattern", "size", "support", "gradient"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["p3_found", "p3_valid", "p6_totals", "best_ngram", "ngram_gapped", "match_gapped", "score_docs", "tune_report", "grad_bounds", "model_predictors", "steps_files", "model_files", "model_trie", "eval_ranked", "line_search_refine", "src_strip_cr"])
def test_same_as_sql(spark, name):
    import duckdb
    import pandas as pd

    import verify

    con = duckdb.connect()
    verify.views(con, SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    want = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    got = entry.queries()[name](spark, SMALL).toPandas().astype(object)
    assert sorted(got.columns) == sorted(want.columns)
    assert verify.canonical(got) == verify.canonical(want)


def test_shared_folder_is_the_sessions(spark):
    assert tables.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert tables.cut(spark.range(3)).count() == 3


def test_once_keeps_null_keys(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "k int, v string")
    assert tables.once(frame, "k").count() == 3
