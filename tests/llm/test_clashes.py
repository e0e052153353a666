"""Columns beside the ones an operator reads, with names that it uses inside, change nothing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gramloom.llm import ledger, mixing, overlap, packing, sentences, spans, subsequences, terms

NAMES = ("side text key id arrived bucket seed pos seeds start h1 h2 low high tokens u most piece place means bin total class_id blocks bits_1 block t e first_id copies n documents opens entries "
         "chunks vocabulary code term docpos mask mark repeats copy all kind container_no members s island new").split()  # fmt: skip


def crowded(frame):
    return frame.withColumns({c: F.lit("other") for c in NAMES if c not in frame.columns})


TOY = [(1, "1", "abcdefghij" * 9, "train", "a", dt.datetime(2025, 1, 1)), (2, "1", "ABCDEFGHIJ" * 9, "test", "a", dt.datetime(2025, 1, 2)), (3, "1", "abcdefghij" * 9, "dev", None, None)]
TOY_SCHEMA = "doc_id long, class_label string, example_sequence string, split_name string, source string, loaded_at timestamp"
SPACE = [(i, 1, t, 1, [-(d + 1), p]) for i, (t, d, p) in enumerate((t, d, p) for d in range(6) for p, t in enumerate("abc"))]
SPACE_SCHEMA = "block_id long, run_id long, ngram string, ngram_size int, loc array<int>"


def rows(frame):
    return sorted(map(str, frame.collect()))


@pytest.mark.parametrize("case", ["p1", "p2", "p4", "p5", "p7", "p8", "p9", "p10"])
def test_other_columns(spark, case):
    toy, space = spark.createDataFrame(TOY, TOY_SCHEMA), spark.createDataFrame(SPACE, SPACE_SCHEMA)
    sized = spark.createDataFrame([(i, "a", 7) for i in range(30)], "doc_id long, source string, tokens long")
    kinds = spark.createDataFrame([("c", 10)], "container_name string, capacity_tokens int")
    goals = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    docs = spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string")
    run = {
        "p1": lambda w: subsequences.frequent_patterns(w(space)),
        "p2": lambda w: overlap.cross_split_pairs(w(toy)),
        "p4": lambda w: terms.token_frequencies(w(space)),
        "p5": lambda w: ledger.copies(*ledger.deduplicate(spark, w(toy))),
        "p7": lambda w: spans.shared_spans(w(toy)),
        "p8": lambda w: packing.pack_documents(w(sized), w(kinds)),
        "p9": lambda w: mixing.mix(spark, w(sized), w(goals)),
        "p10": lambda w: sentences.sentences(spark, w(docs)),
    }[case]
    plain = rows(run(lambda f: f))
    assert plain and rows(run(crowded)) == plain
