import random
from collections import Counter, defaultdict

import pytest

from gramloom.functions.tokens import tokenised
from gramloom.operators import patterns
from gramloom.sources import sequences


def test_lines_to_documents(spark):
    lines = ["+1 ab \r", ";c", "", "-1\ta b", "nolabel", " x", "0 q", "+2x r", "+0012345678901234567890 s", "-12345678901 t"]
    got = [tuple(r) for r in sequences.parse_labelled(sequences.lines_of(spark, lines)).select("class_label", "y", "text").collect()]
    assert got == [("+1", 1, "ab "), ("-1", -1, "a b"), ("", -1, "x"), ("0", -1, "q"), ("+2x", 1, "r"), ("+0012345678901234567890", 1, "s"), ("-12345678901", -1, "t")]


def test_table_of_documents(spark):
    schema = "doc_id long, class_label string, example_sequence string, split_name string, source string, token_type string"
    rows = [(1, " +1\t", "a", "train", None, "word"), (1, " +1\t", "a", "train", None, "word"), (2, "x", "a", None, None, "word"), (3, None, "a", None, None, "word"), (4, "0", None, None, None, "word"), (None, "1", "a", None, None, "word"), (5, "0", "", "dev", "s", "char"), (6, "00012345678901", "a", None, None, "word")]
    docs = sequences.labelled_docs(spark.createDataFrame(rows, schema))
    assert sorted((r["doc_id"], r["y"]) for r in docs.collect()) == [(1, 1), (5, -1), (6, 1)]
    assert sequences.class_counts(docs).collect() == [(3, 2, 1)]


def test_tokenisers(spark):
    docs = spark.createDataFrame([(1, " a  bc\td "), (2, ""), (3, None), (4, "  ")], "doc_id int, text string")
    got = {r["doc_id"]: r["tokens"] for r in tokenised(docs).collect()}
    assert got == {1: ["a", "bc", "d"], 2: [], 3: None, 4: []}
    got = {r["doc_id"]: r["tokens"] for r in tokenised(docs, "char").collect()}
    assert got == {1: ["a", "b", "c", "d"], 2: [], 3: None, 4: []}
    good = spark.createDataFrame([(1, "aé𝄞 ")], "doc_id int, text string")
    assert tokenised(good, "char_strict").first()["tokens"] == ["a", "é", "𝄞"]
    with pytest.raises(Exception, match="white space inside"):
        tokenised(docs, "char_strict").collect()


def brute(docs, maxpat, maxgap):
    """Documents of every pattern, wildcards included."""
    held = defaultdict(set)
    for i, tokens in docs:
        for size in range(1, maxpat + 1):
            for mask in patterns.masks(size, maxgap):
                for s in range(len(tokens) - size + 1):
                    held[tuple("*" if m else t for m, t in zip(mask, tokens[s : s + size]))].add(i)
    return held


@pytest.mark.parametrize(("maxgap", "minsup"), [(0, 1), (0, 3), (1, 3), (2, 2)])
def test_levels_match_brute_force(spark, maxgap, minsup):
    rng = random.Random(maxgap)
    docs = [(i, [rng.choice("abcde*") for _ in range(rng.randint(0, 7))]) for i in range(25)]
    got = Counter(tuple(r["pattern"]) for r in patterns.pattern_docs(spark.createDataFrame(docs, "doc_id int, tokens array<string>"), 1, 4, minsup, maxgap).collect())
    want = {k: len(v) for k, v in brute(docs, 4, maxgap).items() if len(v) >= minsup}
    assert got == want


def test_ranks_go_through_all_ranges(spark):
    rng = random.Random(5)
    every = sorted({tuple(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(300)})
    frame = spark.createDataFrame([(list(p), i) for i, p in enumerate(rng.sample(every, len(every)))], "pattern array<string>, support int").repartition(5)
    assert {tuple(r["pattern"]): r["rank"] for r in patterns.ranked(frame).collect()} == {p: i + 1 for i, p in enumerate(every)}


def test_masks_limit_runs():
    assert patterns.masks(1, 3) == [(0,)]
    assert patterns.masks(4, 1) == [(0, 0, 0, 0), (0, 0, 1, 0), (0, 1, 0, 0)]
    assert (0, 1, 1, 0) in patterns.masks(4, 2)


def test_orders_and_empty(spark):
    counted = spark.createDataFrame([(["b"], 1), (["a", "c"], 2), (["a"], 1)], "pattern array<string>, size int")
    assert [r["pattern"] for r in patterns.first_visited(counted, 3).orderBy("rank").collect()] == [["a"], ["b"], ["a", "c"]]
    assert [r["pattern"] for r in patterns.first_visited(counted, 2, False).orderBy("rank").collect()] == [["a"], ["a", "c"]]
    none = spark.createDataFrame([], "doc_id int, tokens array<string>")
    assert patterns.pattern_docs(none, 1, 2, 2).count() == 0
    assert patterns.vocabulary(none).count() == 0


def test_levels_grow_until_nothing_is_frequent(spark):
    docs = [(i, list("abcde" if i < 3 else "xy")) for i in range(5)]
    frame = spark.createDataFrame(docs, "doc_id int, tokens array<string>")
    for minsup, maxgap in ((1, 0), (3, 0), (3, 1)):
        got = Counter(tuple(r["pattern"]) for r in patterns.pattern_docs(frame, 1, None, minsup, maxgap).collect())
        assert got == {k: len(v) for k, v in brute(docs, 5, maxgap).items() if len(v) >= minsup}
    assert patterns.pattern_docs(frame.limit(0), 1, None, 2).count() == 0


def test_prefixes_of_any_length(spark):
    from gramloom.operators import matcher

    long = [str(i) for i in range(100)]
    docs = spark.createDataFrame([(1, long), (2, long[:70]), (3, ["x"]), (4, [])], "doc_id long, tokens array<string>")
    model = spark.createDataFrame([(long[:n], str(n)) for n in (1, 65, 80)] + [(["0", "*"], "w")], "tokens array<string>, pattern string")
    assert sorted(tuple(r) for r in matcher.prefixes_of(docs, model).collect()) == [(1, "1"), (1, "65"), (1, "80"), (2, "1"), (2, "65")]
