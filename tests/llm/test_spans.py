import random

import numpy as np
import pyarrow as pa
import pytest

from gramloom.llm import catalogue, spans

SCHEMA = "doc_id long, example_sequence string"


def brute(rows, least=60):
    """Spans by looking at every window."""
    texts = {d: t for d, t in rows if d is not None and t is not None}
    where = {}
    for d, t in texts.items():
        for i in range(len(t) - least + 1):
            where.setdefault(t[i : i + least], set()).add(d)
    out = []
    for d, t in texts.items():
        end = start = None
        for i in range(len(t) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                if end is not None and i <= end:
                    end = i + least
                else:
                    if end is not None:
                        out.append((d, start, end))
                    start, end = i, i + least
        if end is not None:
            out.append((d, start, end))
    return sorted(out)


def found(spark, rows):
    return sorted(tuple(r) for r in spans.shared_spans(spark.createDataFrame(rows, SCHEMA)).collect())


def text(rng, n, letters="abcdefghij "):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("seed", [0, 1])
def test_same_as_brute_force(spark, seed):
    rng = random.Random(seed)
    common = [text(rng, rng.randint(55, 140)) for _ in range(6)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(text(rng, rng.randint(0, 90)))
            if rng.random() < 0.5:
                c = rng.choice(common)
                a = rng.randint(0, 20)
                parts.append(c[a : len(c) - rng.randint(0, 20)])
        rows.append((d, "".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, rows[7][1][3:]), (201, "a" * 150), (202, "a" * 90), (203, "ab" * 60), (204, "é𝄞x" * 30), (205, "y" + "é𝄞x" * 30)]
    assert found(spark, rows) == brute(rows)


def test_common_passage_in_many_records(spark):
    rng = random.Random(5)
    passage = text(rng, 80)
    rows = [(d, text(rng, d % 50) + passage + text(rng, 40)) for d in range(120)]
    got = found(spark, rows)
    assert got == brute(rows) and len(got) == 120


def test_nulls_short_and_repeated(spark):
    long = "".join(chr(97 + i % 26) + str(i) for i in range(60))
    rows = [(1, long), (1, long), (2, None), (3, ""), (None, long), (4, "short")]
    assert found(spark, rows) == []
    assert found(spark, []) == []
    assert found(spark, [*rows, (5, "x" + long)]) == brute([*rows, (5, "x" + long)])
    shares = spans.shared_share(spark.createDataFrame(rows, SCHEMA), spans.shared_spans(spark.createDataFrame([*rows, (5, "x" + long)], SCHEMA)))
    assert {r["doc_id"]: r["shared_share"] for r in shares.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_chains_are_best_and_hold_every_fragment():
    rng = random.Random(2)

    def best(fragments):
        """The best chain's score, trying every predecessor."""
        score = {}
        for x, y, n in sorted(fragments):
            score[x, y, n] = float(n)
            for (a, b, m), s in list(score.items()):
                if a < x and b < y:
                    score[x, y, n] = max(score[x, y, n], n + s - spans.GAP_COST * (x - a - m + y - b - m))
        return max(score.values())

    for _ in range(60):
        # fragments that don't overlap, so that every predecessor adds the same
        fragments = [(35 * rng.randint(0, 12), 35 * rng.randint(0, 12), rng.randint(20, 34)) for _ in range(rng.randint(1, 14))]
        got = spans.chains(fragments)
        assert sorted(m for _, c in got for m in c) == sorted(set(fragments))
        assert all(a[0] < b[0] and a[1] < b[1] for _, c in got for a, b in zip(c, c[1:]))
        assert got[0][0] == pytest.approx(best(set(fragments)))


def test_fragments_on_a_diagonal_are_one():
    assert spans.on_diagonals([(5, 2, 30), (10, 7, 40), (50, 47, 20), (5, 3, 20), (80, 77, 9)]) == [(5, 2, 65), (5, 3, 20), (80, 77, 9)]
    assert spans.on_diagonals([(5, 2, 30), (5, 2, 30), (6, 3, 4)]) == [(5, 2, 30)]


def test_edits_of_gaps():
    rng = random.Random(6)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for _ in range(100):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert spans.edits(np.array(a), np.array(b)) == distance(a, b)


def test_fuzzy_passages(spark):
    rng = random.Random(9)
    a = text(rng, 400)
    b = "z" * 30 + a[:150] + "#" + a[151:300] + "##" + a[300:]
    r = spans.fuzzy_passages(spark.createDataFrame([(1, a), (2, b), (3, text(rng, 300)), (4, None), (4, ""), (None, a)], SCHEMA)).collect()
    assert len(r) == 1 and (r[0]["start_1"], r[0]["end_1"], r[0]["start_2"], r[0]["end_2"]) == (0, 400, 30, 432)
    assert r[0]["exact_chars"] == 399 and r[0]["edits"] == 3
    assert spans.fuzzy_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chains_decide_which_passages_there_are(spark):
    rng = random.Random(10)
    # no stretch of 60 characters is the same, but three of 58 are, in order
    parts = [text(rng, 58) for _ in range(3)]
    rows = [(1, text(rng, 70) + "?".join(parts) + text(rng, 70)), (2, text(rng, 90) + "!!".join(parts) + text(rng, 60))]
    frame = spark.createDataFrame(rows, SCHEMA)
    r = spans.fuzzy_passages(frame).collect()
    assert len(r) == 1 and r[0]["exact_chars"] >= 3 * 58 and r[0]["edits"] == 4 and spans.shared_spans(frame).count() == 0
    assert [c[1] for c in spans.chains([(0, 0, 40), (41, 42, 40), (82, 84, 40)])] == [[(0, 0, 40), (41, 42, 40), (82, 84, 40)]]
    fragments = spark.createDataFrame([(1, 2, 70, 90, 40), (1, 2, 111, 132, 40), (1, 2, 152, 174, 40)], spans._FRAGMENT_SQL)
    assert [(r["start_1"], r["end_1"]) for r in spans.passages(fragments).collect()] == [(70, 192)]


def test_fuzzy_passages_of_common_seeds(spark):
    rng = random.Random(4)
    # texts 0 and 1 also share a passage of their own before the one that all texts hold
    passage, own = text(rng, 200), text(rng, 200)
    texts = {d: text(rng, 30 + d % 7) + (own + text(rng, 9) if d < 2 else "") + passage + text(rng, 20) for d in range(150)}
    rows = {(r["doc_id_1"], r["doc_id_2"]): r for r in spans.fuzzy_passages(spark.createDataFrame(list(texts.items()), SCHEMA)).collect()}
    # a row for each member of the group; others only where the letter next to the passage is the same in at most 16 texts
    assert set(rows) >= {(0, b) for b in range(1, 150)} and len(rows) < 0.3 * 150 * 149 / 2
    assert all(r["exact_chars"] >= 200 for r in rows.values())
    # rare and common seeds stand in one chain
    assert rows[0, 1]["end_1"] - rows[0, 1]["start_1"] > 400 and rows[0, 1]["exact_chars"] >= 400


def test_groups_that_span_batches_are_paired():
    rng = random.Random(7)
    rows = sorted((s, c, 40, "".join(rng.choice("ab") for _ in range(40)) + f"seed{s:016d}" + "x" * 40) for s in range(6) for c in rng.sample(range(50), 1 + s))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*part)], names=["seed", "class_id", "pos", "context"])
    whole = sorted(tuple(r.values()) for b in spans._paired(iter([batch(rows)]), 40, 20) for r in b.to_pylist())
    small = sorted(tuple(r.values()) for b in spans._paired(iter([batch(rows[i : i + 2]) for i in range(0, len(rows), 2)]), 40, 20) for r in b.to_pylist())
    assert whole == small and len(whole) == sum(s * (s + 1) // 2 for s in range(6)) and all(a < b for a, b, *_ in whole)


def test_texts_of_very_many_records(spark):
    same, other = "".join(chr(97 + i % 26) + str(i) for i in range(40)), "".join(chr(65 + i % 26) + str(i) for i in range(50))
    rows = [(i, same) for i in range(1, 1300)] + [(2000, other), (2001, "?" + other), (2002, same + "!")]
    assert found(spark, rows) == sorted([(i, 0, len(same)) for i in range(1, 1300)] + [(2000, 0, len(other)), (2001, 1, 1 + len(other)), (2002, 0, len(same))])


def test_all_pairs_of_common_seeds_have_their_passages(spark, tmp_path):
    rng = random.Random(12)
    # texts 7 and 9 also share a passage of their own; 90 texts are more than one side of a cell
    passage, own = text(rng, 200), text(rng, 200)
    texts = {d: text(rng, 30 + d % 7) + (own + text(rng, 9) if d in (7, 9) else "") + passage + text(rng, 20) for d in range(90)}
    spark.createDataFrame(list(texts.items()), SCHEMA).write.parquet(str(tmp_path / "toy.parquet"))
    got = catalogue.p7_passages(spark, str(tmp_path)).collect()
    rows = {(r["doc_id_1"], r["doc_id_2"]): r for r in got}
    assert len(got) == len(rows) and set(rows) == {(a, b) for a in range(90) for b in range(a + 1, 90)}
    assert all(r["exact_chars"] >= 200 for r in got)
    # rare and common seeds stand in one chain
    assert rows[7, 9]["end_1"] - rows[7, 9]["start_1"] > 400 and rows[7, 9]["exact_chars"] >= 400


def test_cells_give_the_pairs_of_whole_groups(spark, monkeypatch):
    rng = random.Random(13)
    passages = [text(rng, 90) for _ in range(3)]
    rows = [(d, text(rng, 10) + rng.choice(passages) + text(rng, 15) + (rng.choice(passages) if d % 3 else "") + text(rng, 10)) for d in range(70)] + [(100, "ab" * 45), (101, "ab" * 50)]
    frame = spark.createDataFrame(rows, SCHEMA)
    all_of = lambda: sorted(tuple(r) for r in spans.fuzzy_passages(frame, every=True).collect())
    monkeypatch.setattr(spans, "SIDE", 5)
    cells = all_of()
    monkeypatch.setattr(spans, "PAIRED", 1_000_000)
    assert cells == all_of() and len({r[:2] for r in cells}) > 1000
