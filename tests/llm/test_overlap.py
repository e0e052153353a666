import random

import numpy as np
import pyarrow as pa

from gramloom.llm import overlap

SCHEMA = "doc_id long, class_label string, example_sequence string, split_name string, source string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        k, i = rng.randint(0, 2), rng.randrange(len(s))
        if k == 0:
            s[i] = rng.choice("abcdefghijklmnopqrst")
        elif k == 1:
            del s[i]
        else:
            s.insert(i, rng.choice("abcdefghijklmnopqrst"))
    return "".join(s)


def pairs(spark, rows):
    return sorted(tuple(r) for r in overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA)).collect())


def test_recall_and_exactness_against_brute_force(spark):
    rng = random.Random(8)
    rows, planted = [], {}
    for i in range(160):
        text = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.choice([30, 60, 150, 400])))
        rows.append((2 * i, "1", text, "train", None))
        share = rng.choice([0, 0.01, 0.03, 0.05, 0.08])
        rows.append((2 * i + 1, "-1", edited(rng, text, int(share * len(text))).upper(), rng.choice(["dev", "test"]), None))
        planted[2 * i, 2 * i + 1] = share
    texts = {r[0]: r[2].lower() for r in rows}
    want = {p for p in planted if distance(texts[p[0]], texts[p[1]]) <= max(len(texts[p[0]]), len(texts[p[1]])) // 10}
    got = set(pairs(spark, rows))
    assert got <= want
    low = {p for p in want if planted[p] <= 0.05}
    assert len(got & low) >= 0.99 * len(low) and len(got) >= 0.95 * len(want)


def test_defined_cases(spark):
    a = "the quick brown fox jumps over the lazy dog"
    rows = [
        (1, "1", a, "train", "s"), (2, "1", a.upper() + "!!", "test", "s"), (3, "1", a, "train", "s"), (1, "1", a, "train", "s"), (4, a, "-1", "dev", None),
        (5, "1", None, "dev", "s"), (6, "1", a, None, "s"), (7, "1", a, "other", "s"), (None, "1", a, "dev", "s"),
        (8, "1", "", "train", "s"), (9, "1", " -- ", "dev", "s"), (10, "1", "ab", "train", "s"), (11, "1", "AB", "dev", "s"), (12, "1", "ac", "dev", "s"),
    ]
    got = pairs(spark, rows)
    assert got == [(1, 2), (1, 4), (3, 2), (3, 4), (8, 9), (10, 11)]
    frame = spark.createDataFrame(rows, SCHEMA)
    counts = {(r["split_name"], r["source"]): (r["n_records"], r["n_pairs"]) for r in overlap.overlap_counts(frame).collect()}
    assert counts == {("test", "s"): (1, 2), ("dev", None): (1, 2), ("dev", "s"): (2, 2)}
    assert pairs(spark, []) == []


def test_bits_follow_resemblance():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(300))
    blocks, bits = overlap.fingerprints(pa.array([a, edited(rng, a, 6), a[::-1], a, "", None, "x"]))
    apart = [int(np.bitwise_count((bits[0] ^ bits[i]).view(np.uint64)).sum()) for i in range(4)]
    assert apart[3] == 0 and apart[1] < overlap.RADIUS < apart[2]
    assert (blocks[0] == blocks[3]).all() and (blocks[4] == blocks[5]).all() and not (blocks[4] == blocks[6]).any()


def test_pairs_across_both_gram_sizes(spark):
    rng = random.Random(12)
    rows, want = [], set()
    for i in range(90):
        n = overlap.SHORT - 4 + i % 9
        text = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
        # characters put in or taken out, so that the partner lies on the other side
        at = sorted(rng.sample(range(n), 1 if n in (overlap.SHORT - 1, overlap.SHORT) else abs(overlap.SHORT - n) + (n > overlap.SHORT)))
        other = "".join(c + "z" * (n < overlap.SHORT) if j in at else c for j, c in enumerate(text) if n < overlap.SHORT or j not in at)
        assert (len(text) < overlap.SHORT) != (len(other) < overlap.SHORT)
        rows += [(2 * i, "1", text, "train", None), (2 * i + 1, "1", other, "dev", None)]
        if distance(text, other) <= max(len(text), len(other)) // 10:
            want.add((2 * i, 2 * i + 1))
    got = pairs(spark, rows)
    assert len(want) >= 80 and len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.95 * len(want)


def test_recall_up_to_ten_per_cent(spark):
    rng = random.Random(21)
    rows, want = [], set()
    for i in range(420):
        n = (10, 20, 48, 60, 100, 300, 400)[i % 7]
        text = "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
        other = edited(rng, text, n // 10)
        rows += [(2 * i, "1", text, "train", None), (2 * i + 1, "1", other, "test", None)]
        if distance(text, other) <= max(n, len(other)) // 10:
            want.add((2 * i, 2 * i + 1))
    got = set(pairs(spark, rows))
    assert len(want) > 400 and got <= want and len(got) >= 0.95 * len(want)
    for k in range(7):
        assert len({p for p in got if p[0] // 2 % 7 == k}) >= 0.95 * len({p for p in want if p[0] // 2 % 7 == k})


def test_hot_classes_are_paired_in_parts(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PART", 5)
    rows = [(i, "1", "the same text for all of them", "train", "s") for i in range(23)] + [(100 + i, "1", "The same text for ALL of them!", "dev", "s") for i in range(17)]
    rows += [(200, "1", "another text that stands alone", "train", "s"), (201, "1", "another text that stands alone.", "test", None)]
    assert pairs(spark, rows) == sorted([(i, 100 + j) for i in range(23) for j in range(17)] + [(200, 201)])
    counts = {(r["split_name"], r["source"]): (r["n_records"], r["n_pairs"]) for r in overlap.overlap_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert counts == {("dev", "s"): (17, 391), ("test", None): (1, 1)}
