import random

from pyspark.sql import functions as F

from gramloom.operators import postings
from gramloom.plans import loading

SCHEMA = "block_id long, run_id long, ngram string, ngram_size int, loc array<int>"


def blocks_of(seed, n=300):
    """Blocks of random lists, cut anywhere, some delivered twice, and the truth: ngram -> set of (run, doc, pos)."""
    rng, rows, truth, docs = random.Random(seed), [], {}, {}
    for run in (1, 2):
        for ngram in ("a", "b", "c"):
            loc = []
            for doc in sorted(rng.sample(range(n), n // 3 if ngram == "a" else 5)):
                for pos in sorted(rng.sample(range(200), rng.randint(1, 4))):
                    loc += [-(doc + 1), pos] if rng.random() < 0.3 or not loc or loc[-1] < 0 or open_doc != doc else [pos]
                    open_doc = doc
                    truth.setdefault(ngram, set()).add((run, doc, pos))
                    docs.setdefault(ngram, set()).add((run, doc))
            at = 0
            while at < len(loc):
                end = at + rng.randint(3, 9)
                part = loc[at:end]
                if part[0] >= 0:
                    last = next(x for x in reversed(loc[:at]) if x < 0)
                    part = [last, *part]
                rows += [(len(rows), run, ngram, 1, part)] * (2 if rng.random() < 0.2 else 1)
                at = end
    return rows, truth, docs


def test_totals_match_brute_force(spark):
    rows, truth, docs = blocks_of(3)
    masks = postings.position_masks(spark.createDataFrame(rows, SCHEMA), ["ngram", "run_id"])
    got = {r["ngram"]: tuple(r)[1:] for r in postings.key_totals(masks, ["ngram"], ["run_id"]).collect()}
    assert got == {k: (len(v), len(docs[k]), min(p for *_, p in v), max(p for *_, p in v)) for k, v in truth.items()}


def test_algebraic_totals_match_brute_force(spark, monkeypatch):
    rows, truth, _ = blocks_of(4)
    want = {k: (len(v), min(p for *_, p in v), max(p for *_, p in v)) for k, v in truth.items()}
    for limit in (1_000_000, 0):
        monkeypatch.setattr(postings, "BROADCAST_ROWS", limit)
        assert {r["ngram"]: tuple(r)[1:] for r in postings.block_totals(spark.createDataFrame(rows, SCHEMA), ["ngram"]).collect()} == want


def test_algebraic_totals_of_odd_lists(spark):
    frame = spark.createDataFrame(
        [(1, 1, "a", 1, None), (2, 1, "a", 1, []), (3, 1, "a", 1, [5, -2, 7]), (4, 1, "a", 1, [None, 9, -3, 1]), (4, 1, "a", 1, [None, 9, -3, 1]), (5, 1, None, 1, [-1, 1]), (6, 1, "c", 1, [-5]), (None, 1, "d", 1, [-1, 4]), (None, 1, "d", 1, [-2, 6, None, 3])], SCHEMA
    )
    got = {r["ngram"]: tuple(r)[1:] for r in postings.block_totals(frame, ["ngram"]).collect()}
    assert got == {"a": (2, 1, 7), None: (1, 1, 1), "c": (0, None, None), "d": (2, 4, 6)}
    assert postings.block_totals(spark.createDataFrame([], SCHEMA), ["ngram"]).count() == 0


def test_positions_at_word_edges(spark):
    frame = spark.createDataFrame([(1, 1, "a", 1, [-1, 63]), (2, 1, "b", 1, [-1, 0, 64, 127, 128]), (3, 1, "c", 1, [-5])], SCHEMA)
    got = {r["ngram"]: tuple(r)[1:] for r in postings.key_totals(postings.position_masks(frame, ["ngram", "run_id"]), ["ngram"], ["run_id"]).collect()}
    assert got == {"a": (1, 1, 63, 63), "b": (4, 1, 0, 128), "c": (0, 1, None, None)}


def test_nulls_empties_and_orphans(spark):
    frame = spark.createDataFrame([(1, 1, "a", 1, None), (2, 1, "a", 1, []), (3, 1, "a", 1, [5, -2, 7]), (4, 1, "a", 1, [None, 9, -3, 1]), (5, 1, None, 1, [-1, 1])], SCHEMA)
    masks = postings.position_masks(frame, ["ngram", "run_id"])
    got = {r["ngram"]: (r["occurrences"], r["documents"]) for r in postings.key_totals(masks, ["ngram"], ["run_id"]).collect()}
    assert got == {"a": (2, 2), None: (1, 1)}
    empty = postings.position_masks(spark.createDataFrame([], SCHEMA), ["ngram", "run_id"])
    assert postings.heavy_keys(postings.key_totals(empty, ["ngram"], ["run_id"]), ["ngram"], 0.03).count() == 0


def test_documents_are_rebuilt(spark):
    frame = spark.createDataFrame([(1, 1, "x", 1, [-1, 0, 2]), (2, 1, "y", 1, [-1, 1]), (2, 1, "y", 1, [-1, 1]), (3, 1, "x y", 2, [-1])], SCHEMA)
    assert postings.documents_of(frame).collect() == [(1, 0, ["x", "y", "x"])]
    assert postings.count_documents(frame, ["run_id"]).collect() == [(1, 1)]


def test_heavy_keys_need_their_share(spark):
    totals = spark.createDataFrame([("a", 97), ("b", 3), ("c", 0)], "ngram string, occurrences long")
    assert {r["ngram"] for r in postings.heavy_keys(totals, ["ngram"], 0.03).collect()} == {"a", "b"}
    assert set(loading.QUERIES) == set(loading.SQL)


def test_extra_columns_do_not_clash(spark):
    frame = spark.createDataFrame([(1, 1, "a", 1, [-1, 2])], SCHEMA).withColumn("mask", F.lit("x")).withColumn("docpos", F.lit("y"))
    assert postings.key_totals(postings.position_masks(frame, ["ngram", "run_id"]), ["ngram"], ["run_id"]).first()["occurrences"] == 1
