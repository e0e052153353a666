import random
from collections import Counter
from itertools import product

import pytest

from gramloom.llm import subsequences as S

SCHEMA = "block_id long, run_id long, ngram string, ngram_size int, loc array<int>"


def blocks(docs, run=1, first=0):
    """The lists of single tokens of documents (lists of tokens), one block for each token and document."""
    rows = []
    for d, tokens in enumerate(docs):
        for t in sorted(set(tokens)):
            rows.append((first + len(rows), run, t, 1, [-(d + 1), *(i for i, x in enumerate(tokens) if x == t)]))
    return rows


def brute(docs, least=5, share=0.1, gap=3, lengths=(3, 4)):
    counts = Counter()
    for tokens in docs:
        held = set()
        for n in lengths:
            for start in range(len(tokens)):
                for steps in product(range(1, gap + 1), repeat=n - 1):
                    at = [start]
                    for s in steps:
                        at.append(at[-1] + s)
                    if at[-1] < len(tokens):
                        held.add(" ".join(tokens[i] for i in at))
        counts.update(held)
    return {k: v for k, v in counts.items() if v >= max(least, share * len(docs))}


def made(seed, n=70, alphabet="abcdefghij"):
    rng = random.Random(seed)
    return [[rng.choice(alphabet) for _ in range(rng.randint(1, 12))] for _ in range(n)]


@pytest.mark.parametrize(("chunk", "broadcast"), [(400_000, 200_000), (60, 200_000), (400_000, 0)])
def test_same_as_brute_force(spark, monkeypatch, chunk, broadcast):
    monkeypatch.setattr(S, "BROADCAST_ROWS", broadcast)
    one, two = made(1), made(2, 30, "abcd")
    rows = blocks(one, 1) + blocks(two, 2, 10_000)
    rows += rows[::7]  # delivered twice
    got = {(r["run_id"], r["pattern"]): r["support"] for r in S.frequent_patterns(spark.createDataFrame(rows, SCHEMA), chunk=chunk).collect()}
    assert got == {(1, k): v for k, v in brute(one).items()} | {(2, k): v for k, v in brute(two).items()}


def test_exactly_a_tenth(spark):
    docs = [["p", "q", "r"]] * 7 + [["x"]] * 63
    assert {r["pattern"] for r in S.frequent_patterns(spark.createDataFrame(blocks(docs), SCHEMA)).collect()} == {"p q r"}
    docs.append(["x"])
    assert S.frequent_patterns(spark.createDataFrame(blocks(docs), SCHEMA)).count() == 0


def test_blocks_cut_anywhere_and_odd_rows(spark):
    rows = [(1, 1, "a", 1, [-1, 0, -2, 0, -3, 0]), (2, 1, "a", 1, [-4, 0, -5, 0]), (3, 1, "b", 1, [-1, 1, -2, 1, -3, 1, -4, 1, -5]), (4, 1, "b", 1, [-5, 1])]
    rows += [(5, 1, "c", 1, [-1, 4, -2, 4, -3, 4, -4, 4, -5, 4]), (6, 1, None, 1, [-1, 1]), (7, None, "a", 1, [-1, 1]), (8, 1, "a", 1, None), (9, 1, "a", 1, []), (10, 1, "b c", 2, [-1])]
    assert [tuple(r) for r in S.frequent_patterns(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, "a b c", 5)]
    assert S.frequent_patterns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_continuations_are_shared():
    import numpy as np

    packed = np.array([(d << 24) | p for d in range(50) for p in range(4)])
    d = S.Diagram(packed, np.tile(np.arange(4), 50), 3)
    d.link()
    node = np.unique(d.token, return_inverse=True)[1]
    for _ in range(3):
        node, tokens, _ = d.share(node)
    assert len(tokens) == 4  # 200 entries, four nodes
