import math
import os
import random
from itertools import combinations

import numpy as np
import pytest

from gramloom.llm import mixing, packing, tokens

SIZED = "doc_id long, tokens long"


def test_fullest_against_all_subsets():
    rng = random.Random(0)
    for _ in range(150):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        room = rng.randint(1, 80)
        left = {n: sizes.count(n) for n in sizes}
        got = packing.fullest(left, sorted(left, reverse=True), room)
        want = max(sum(c) for k in range(len(sizes) + 1) for c in combinations(sizes, k) if sum(c) <= room)
        assert sum(got) == want and all(got.count(n) <= left[n] for n in got)


def test_containers_are_never_overfull():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 500, 3000)
    number = packing.pack(sizes, 512)
    used = np.bincount(number, weights=sizes)
    assert used.max() <= 512 and used.sum() == sizes.sum()
    assert len(used) <= np.ceil(sizes.sum() / 512) * 1.03
    assert (packing.pack(np.zeros(4, int), 10) == 0).all() and len(packing.pack(np.zeros(0, int), 10)) == 0
    assert len(set(packing.pack(np.full(10, 6), 10))) == 10


def test_every_document_gets_a_place(spark):
    rows = [(1, 0), (2, None), (3, 5), (4, 25), (5, 10), (5, 10), (None, 3), (6, 20)]
    kinds = spark.createDataFrame([("s", 10), ("l", 100), (None, 5), ("bad", 0), ("null", None)], "container_name string, capacity_tokens int")
    got = packing.pack_documents(spark.createDataFrame(rows, SIZED), kinds, group=3).collect()
    small = [r for r in got if r["container_name"] == "s"]
    assert {r["container_name"] for r in got} == {"s", "l"}
    assert sorted((r["piece"], r["tokens"]) for r in small if r["doc_id"] == 4) == [(0, 10), (1, 10), (2, 5)]
    assert len([r for r in small if r["doc_id"] == 5]) == 2 and {r["doc_id"] for r in small} == {1, 2, 3, 4, 5, 6, None}
    full = {}
    for r in got:
        full[r["container_name"], r["container_no"]] = full.get((r["container_name"], r["container_no"]), 0) + r["tokens"]
    assert all(v <= {"s": 10, "l": 100}[k] for (k, _), v in full.items())
    assert packing.pack_documents(spark.createDataFrame([], SIZED), kinds).count() == 0
    assert packing.pack_documents(spark.createDataFrame(rows, SIZED), kinds.limit(0)).count() == 0


def test_usage(spark):
    kinds = spark.createDataFrame([("s", 10)], "container_name string, capacity_tokens int")
    packed = packing.pack_documents(spark.createDataFrame([(i, 5) for i in range(4)], SIZED), kinds)
    r = packing.usage(packed, kinds).first()
    assert (r["n_containers"], r["tokens"], r["unused_share"]) == (2, 20, 0.0)


def poisson_below(j, mean):
    term = total = np.exp(-mean)
    for i in range(1, j):
        term = term * mean / i
        total += term
    return total


def test_means_invert_the_distribution():
    u = np.array([0.001, 0.3, 0.5, 0.97, 0.999999])
    got = mixing.means(u, 6)
    for i, x in enumerate(u):
        assert all(abs(poisson_below(j + 1, got[i, j]) - x) < 1e-6 for j in range(6))
    assert (np.diff(got, axis=1) > 0).all()


def test_means_of_many_copies():
    u = np.array([1e-6, 0.1, 0.5, 0.9, 0.999999])
    got = mixing.means(u, 1000)
    assert (np.diff(got, axis=1) > 0).all()
    for j in (1, 2, 63, 64, 65, 66, 200, 700, 800, 1000):
        for x, m in zip(u, got[:, j - 1]):
            terms = np.array([-m + i * np.log(m) - math.lgamma(i + 1) for i in range(j)])
            assert np.exp(terms - terms.max()).sum() * np.exp(terms.max()) == pytest.approx(x, rel=1e-6)


def test_many_repeats(spark):
    sized = spark.createDataFrame([(i, "s", 10) for i in range(20)] + [(100 + i, "l", 10) for i in range(40_000)], MIX)
    targets = spark.createDataFrame([("s", 0.3, 1000), ("l", 0.7, 1)], TARGET)
    chosen = mixing.mix(spark, sized, targets)
    got = {r["source"]: r for r in mixing.shares(chosen, sized, targets).collect()}
    assert got["l"]["n_copies"] == 40_000 and abs(got["s"]["actual_share"] - 0.3) < 0.0005 and got["s"]["most_repeats"] <= 1000


MIX = "doc_id long, source string, tokens long"
TARGET = "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark):
    rng = random.Random(3)
    rows = [(i, s, rng.randint(1, 200)) for i, s in enumerate(rng.choices(["a", "b", "c", "d", None], [60, 25, 5, 5, 5], k=9000))]
    sized = spark.createDataFrame(rows, MIX)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 6), ("gone", 0.0, 1)], TARGET)
    chosen = mixing.mix(spark, sized, targets)
    got = {r["source"]: r for r in mixing.shares(chosen, sized, targets).collect()}
    for s, share, most in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 6)):
        assert abs(got[s]["actual_share"] - share) < 0.002 and got[s]["n_copies"] > 0 and got[s]["most_repeats"] <= most
    assert got["d"]["n_copies"] == 0 and got[None]["n_copies"] == 0
    again = mixing.mix(spark, sized.repartition(7), targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))
    copies = mixing.shuffled(chosen)
    assert copies.count() == sum(r["n_copies"] for r in got.values())
    order = [r["place"] for r in copies.collect()]
    assert order == sorted(order) and len(set(order)) == len(order)


def test_mixes_of_nothing(spark):
    targets = spark.createDataFrame([("a", 0.5, 1)], TARGET)
    none = spark.createDataFrame([], MIX)
    assert mixing.mix(spark, none, targets).count() == 0
    assert mixing.mix(spark, spark.createDataFrame([(1, "a", 0), (2, None, 5)], MIX), targets).count() == 0
    assert mixing.mix(spark, spark.createDataFrame([(1, "a", 5)], MIX), targets.limit(0)).count() == 0
    assert mixing.shares(mixing.mix(spark, none, targets), none, targets).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokens_are_counted(spark, name):
    path = os.path.join(os.path.dirname(tokens.VOCABULARY), name)
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    frame = spark.createDataFrame([(1, "hello world", "t"), (2, None, "t"), (3, "", "t"), (4, "x" * 20_000, "t"), (5, "<|endoftext|>", "t")], "doc_id long, text string, tokens string")
    got = {r["doc_id"]: r["tokens"] for r in tokens.with_tokens(spark, frame, vocabulary=path).collect()}
    assert got[1] >= 2 and got[2] == got[3] == 0 and got[4] > 1000 and got[5] > 1
