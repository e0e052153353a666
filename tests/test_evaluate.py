import random

import pytest

from gramloom.operators import evaluate

SCHEMA = "y int, score double, n_matched long"


def frame(spark, rows):
    return spark.createDataFrame([(y, s, 1) for y, s in rows], SCHEMA)


def pair_auc(rows):
    pos, neg = [s for y, s in rows if y > 0], [s for y, s in rows if y <= 0]
    if not pos or not neg:
        return 0.0
    return 100 * sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def walked_auc50(rows, most=50):
    """By walking the tie groups from the highest score down."""
    groups = sorted({s for _, s in rows}, reverse=True)
    all_p = sum(y > 0 for y, _ in rows)
    if not all_p:
        return 0.0
    area, tp, fp = 0.0, 0, 0
    for s in groups:
        p, n = sum(y > 0 and x == s for y, x in rows), sum(y <= 0 and x == s for y, x in rows)
        if fp + n >= most and sum(y <= 0 for y, _ in rows) > most:
            return 100 * (area + (most - fp) * (tp + all_p) / 2) / (all_p * most)
        area += n * (tp + tp + p) / 2
        tp, fp = tp + p, fp + n
    return 100 * area / (all_p * most)


def swept(rows):
    scores = sorted({s for _, s in rows})
    options = [(sum(y <= 0 for y, _ in rows), -1.7976931348623157e308)] + [(None, (a + b) / 2) for a, b in zip(scores, scores[1:])] + [(sum(y > 0 for y, _ in rows), scores[-1] + 1)]
    full = [(sum((s > t) != (y > 0) for y, s in rows), t) for _, t in options]
    return min(full)


@pytest.mark.parametrize("seed", range(4))
def test_sweeps_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, -1, -1]), round(rng.gauss(0, 1), 1 if seed % 2 else 4)) for _ in range(rng.choice([7, 150]))]
    got = frame(spark, rows)
    assert evaluate.auc(got).first()["auc"] == pytest.approx(pair_auc(rows))
    assert evaluate.auc50(got).first()["auc50"] == pytest.approx(walked_auc50(rows))
    errors, threshold = swept(rows)
    best = evaluate.tuned(got).first()
    assert (best["errors"], best["threshold"]) == (errors, pytest.approx(threshold))


def test_known_report(spark):
    rows = spark.createDataFrame([(1, 0.6862171, 3), (1, -0.1174653, 2), (-1, -0.3906512, 2), (-1, 0.0, 0)], SCHEMA)
    r = evaluate.report(rows).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["oov_docs"]) == (1, 0, 1, 2, 1)
    assert [round(r[c], 3) for c in ("accuracy", "precision", "recall", "f1", "specificity", "fss", "balanced_error", "auc", "auc50")] == [75, 100, 50, 66.667, 100, 66.667, 25, 75, 3]


def test_known_threshold(spark):
    rows = [(1, 0.4718794), (1, 0.5736915), (-1, -0.3992972), (-1, -0.3226226)]
    r = evaluate.tune_report(frame(spark, rows)).first()
    assert round(r["best_threshold"], 7) == 0.0746284 and r["min_errors"] == 0 and r["accuracy"] == 100


def test_one_class_ties_and_nothing(spark):
    only = frame(spark, [(1, 0.5), (1, 0.5)])
    assert evaluate.auc(only).first()["auc"] == 0 and evaluate.measures(evaluate.confusion(only)).first()["balanced_error"] is None
    assert evaluate.auc(frame(spark, [(1, 0.5), (-1, 0.5)])).first()["auc"] == 50
    none = frame(spark, [])
    assert evaluate.auc(none).first()["auc"] == 0 and evaluate.tuned(none).count() == 0 and evaluate.measures(evaluate.confusion(none)).first()["accuracy"] == 0
    assert evaluate.auc50(none).first()["auc50"] == 0
