import os

import pytest
from conftest import SMALL

from gramloom.llm import catalogue


def test_found_columns(spark):
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    want = {
        "p1_found": ["run_id", "pattern"], "p2_found": ["doc_id_1", "doc_id_2"], "p4_found": ["ngram", "mark"], "p5_found": ["first_doc_id", "copy_doc_id"],
        "p7_found": ["doc_id", "span_start", "span_end"], "p10_found": ["doc_id", "sent_start", "sent_end"],
    }
    for name, columns in want.items():
        got = catalogue.QUERIES[name](spark, SMALL)
        assert got.columns == columns and got.count() == got.distinct().count() > 0
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
