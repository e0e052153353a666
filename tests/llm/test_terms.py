import random
from collections import defaultdict

import pyarrow as pa

from gramloom.llm import terms

SCHEMA = "block_id long, run_id long, ngram string, ngram_size int, loc array<int>"


def test_tokens_match_brute_force(spark):
    rng = random.Random(4)
    rows, occ, docs, every = [], defaultdict(set), defaultdict(set), set()
    for i in range(400):
        t = rng.choice(["hot"] * 6 + [f"t{j}" for j in range(60)])
        run, loc = rng.randint(1, 3), []
        for d in sorted(rng.sample(range(40), 2)):
            loc.append(-(d + 1))
            for p in sorted(rng.sample(range(130), rng.randint(0, 3))):
                loc.append(p)
                occ[t].add((run, d, p))
            docs[t].add((run, d))
            every.add((run, d))
        rows += [(i, run, t, 1, loc)] * rng.choice([1, 1, 2])
    got = {r["ngram"]: tuple(r)[1:] for r in terms.token_frequencies(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    mark = lambda n: "rare" if n < 5 else "common" if n > 0.25 * len(every) else None
    assert got == {t: (len(occ[t]), len(d), mark(len(d))) for t, d in docs.items()}


def test_rules(spark):
    schema = "rule_id long, run_id long, step int, ngram string, loc array<int>"
    rows = [(1, 1, 3, "a", [0, 1, 2]), (1, 1, 3, "a", [0, 1, 2]), (2, 1, 70, "a", [2]), (3, 2, 1, "a", [0]), (4, 1, 5, "b", None), (5, 1, 6, "c", []), (6, None, 1, "a", [1]), (7, 1, 2, None, [1]), (8, 1, None, "d", [9, -1])]
    got = {r["ngram"]: (r["occurrences"], r["documents"], r["mark"]) for r in terms.rule_frequencies(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (5, 4, "rare"), "d": (1, 1, "rare")}


def test_empty(spark):
    assert terms.token_frequencies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scan_carries_runs_over_batches():
    rows = [("a", 1, 0, 1), ("a", 1, 0, 2), ("a", 1, 1 << 24, 0), ("a", 2, 0, 1), ("b", 1, 0, 4), ("b", 1, 0, 4)]
    schema = pa.schema([("term", pa.string()), ("run_id", pa.int64()), ("docpos", pa.int64()), ("mask", pa.int64())])
    for size in range(1, 7):
        parts = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + size])], schema=schema) for i in range(0, 6, size)]
        total = defaultdict(lambda: [0, 0])
        for out in terms._scan(iter(parts)):
            for t, o, d in zip(*(c.to_pylist() for c in out.columns)):
                total[t][0] += o
                total[t][1] += d
        assert dict(total) == {"a": [3, 3], "b": [1, 1]}
