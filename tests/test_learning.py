import math

import numpy as np
import pytest

from gramloom.functions.losses import loss, probability
from gramloom import tables
from gramloom.operators import gradient, learner, linesearch, matcher, model
from gramloom.operators.learner import Params, learn
from gramloom.operators.patterns import pattern_docs
from gramloom.sources import models

TRAIN = [(0, 1, "ab "), (1, 1, "abcd "), (2, -1, "abd "), (3, -1, "bcd ")]
# steps and weights of the known model of these four sequences
STEPS = [("a", 0.193875), ("d", -0.304880485164), ("abc", 0.312411962616), ("abd", -0.260224676687), ("ab", 0.252054120522), ("bd", -0.258162420542), ("abcd", 0.198543068031), ("abc", -0.109861414648)]
WEIGHTS = {"ab": 0.266722081548180, "abc": 0.214337713110443, "abcd": 0.210097023101704, "a": 0.205157302935819, "bd": -0.273185846126522, "abd": -0.275368112580015, "d": -0.322622607628679}


def docs(spark):
    return spark.createDataFrame(TRAIN, "doc_id long, y int, text string")


def steps(spark):
    return spark.createDataFrame([(i + 1, d, p) for i, (p, d) in enumerate(STEPS)], "step int, delta double, pattern string")


def test_recorded_steps(spark):
    got = learn(docs(spark), Params(maxpat=4, compat=True, breadth=False))
    assert [("".join(p), round(d, 12)) for _, d, p in got.steps] == STEPS


@pytest.mark.parametrize("case", [{}, {"maxgap": 1, "minsup": 2}, {"minpat": 2, "breadth": False}, {"maxpat": 3, "maxgap": 2, "minsup": 2, "objective": 2}])
def test_search_finds_the_best_of_all_patterns(spark, case, monkeypatch):
    rng = np.random.default_rng(len(case))
    params = Params(token="word", **case)
    rows = [(int(i), int(rng.choice([-1, 1])), [str(t) for t in rng.choice(list("abcd" if params.maxgap else "abc*"), size=rng.integers(0, 8))]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, y int, tokens array<string>")
    monkeypatch.setattr(learner, "HELD", 4)
    scratch = tables.Scratch(spark)
    tree = learner.Tree(docs.select("doc_id", "tokens"), params, scratch)
    every = pattern_docs(docs, 1, params.maxpat or 8, params.minsup, params.maxgap).cache()
    for i, coef in enumerate(({}, {("a", "b"): 0.7}, {("a", "b"): 0.7, ("c",): -0.4, ("b", "d", "a"): 0.2})):
        state = spark.createDataFrame([(d, y, float(s)) for (d, y, _), s in zip(rows, rng.normal(size=30) * i)], "doc_id long, y int, score double")
        grads = gradient.gradients(every, state, params.objective)
        if coef:
            grads = gradient.regularised(grads, spark.createDataFrame([(list(k), v) for k, v in coef.items()], "pattern array<string>, beta double"))
        want = gradient.best(grads, params.minpat, params.breadth).first()
        top, total, leaves, grown = learner.search(tree, state, coef, True)
        assert list(top["pattern"]) == list(want["pattern"]) and abs(top["gradient"] - want["gradient"]) < 1e-9
        assert leaves <= total <= every.select("pattern").distinct().count()
    scratch.remove()
    every.unpersist()


def test_tokens_that_look_like_wildcards(spark):
    rows = [(i, 1 if i < 8 else -1, ["a", "*" if i % 2 else "x", "b"] if i < 8 else ["a", "b", "*"]) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, y int, tokens array<string>")
    state = docs.select("doc_id", "y").selectExpr("*", "0.0D AS score")
    for maxgap, want in ((0, [["a", "b"], 8]), (1, [["a", "*", "b"], 8])):
        scratch = tables.Scratch(spark)
        tree = learner.Tree(docs.select("doc_id", "tokens"), Params(token="word", maxgap=maxgap, minpat=2), scratch)
        top = learner.search(tree, state, {}, True)[0]
        row = tree.rows().groupBy("pattern").count().where("array_join(pattern, ' ') = '" + " ".join(want[0]) + "'").first()
        assert abs(abs(top["gradient"]) - 4) < 1e-9 and top["pattern"][-1] != "*" and row["count"] == want[1]
        scratch.remove()


def test_scratch_tables_are_removed(spark):
    import os

    scratch = tables.Scratch(spark)
    assert scratch.stored(spark.range(3)).count() == 3
    folder = scratch.folder.removeprefix("file://")
    assert os.path.isdir(folder)
    scratch.remove()
    assert not os.path.exists(folder)


def test_exact_steps_stand_still(spark):
    got = learn(docs(spark), Params(maxpat=4, maxitr=2))
    assert got.steps[0][2] == ("a",)
    # at the exact minimum the derivative vanishes: gradient of the loss plus the penalty's slope
    b = got.steps[0][1]
    assert abs(sum(-y / (1 + math.exp(y * b)) for _, y, t in TRAIN if "a" in t) + 0.2 + 0.8 * b) < 1e-4
    assert got.log_frame(spark).count() == 2
    assert got.steps_frame(spark, "char").count() == 2


def test_learner_without_documents_or_signal(spark):
    assert learn(spark.createDataFrame([], "doc_id long, y int, text string"), Params()).steps == []
    assert learn(spark.createDataFrame([(1, 1, ""), (2, -1, None)], "doc_id long, y int, text string"), Params()).steps == []
    same = spark.createDataFrame([(1, 1, "a"), (2, -1, "a")], "doc_id long, y int, text string")
    assert learn(same, Params()).steps == []


@pytest.mark.parametrize("bad", [{"objective": 1}, {"minsup": 0}, {"alpha": 2}, {"token": "byte"}, {"maxgap": -1}, {"minpat": 3, "maxpat": 2}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        Params(**bad)


def test_model_of_steps(spark):
    got = {r["pattern"]: r for r in model.make_model(steps(spark), separator="").collect()}
    assert {k: round(r["weight"], 12) for k, r in got.items()} == {k: round(v, 12) for k, v in WEIGHTS.items()}
    assert [k for k, _ in sorted(got.items(), key=lambda kv: kv[1]["feature_id"])] == sorted(WEIGHTS)
    assert abs(model.bias(steps(spark)).first()["bias"] + 0.0125687771804646) < 1e-12
    row = model.norms(steps(spark)).first()
    assert abs(row["l1"] - 1.89001314821) < 1e-10 and abs(row["l2"] - 1.27887716003) < 1e-10
    lines = [r[0] for r in models.predictor_lines(model.make_model(steps(spark), separator=""), -0.5).collect()]
    assert lines[0] == "-0.5" and lines[1].endswith(" ab") and lines[-1].endswith(" d")


def test_files_of_steps(spark, tmp_path):
    models.write_steps(steps(spark), str(tmp_path / "m"))
    assert [(r["pattern"], r["delta"]) for r in models.read_steps(spark, str(tmp_path / "m")).collect()] == STEPS
    made = model.make_model(steps(spark), separator="")
    models.write_model(made, str(tmp_path / "p"))
    assert models.read_model(spark, str(tmp_path / "p")).count() == 7


def test_scores_of_known_documents(spark):
    made = model.make_model(steps(spark), separator="")
    tests = spark.createDataFrame([(i, list(t)) for i, t in enumerate(["abc", "ada", "bda", "bc", ""])], "doc_id long, tokens array<string>")
    found = matcher.matches(tests, made)
    got = {r["doc_id"]: r for r in matcher.scores(tests, found).collect()}
    assert [round(got[i]["score"], 7) for i in range(5)] == [0.6862171, -0.1174653, -0.3906512, 0.0, 0.0]
    assert round(got[0]["prob"], 6) == 0.665125 and got[3]["prob"] == 0.5
    assert sorted(r["doc_id"] for r in matcher.unmatched(tests, found).collect()) == [3, 4]
    assert {r["doc_id"]: r["features"] for r in matcher.sparse(found).collect()}[1] == "1:1.0 7:1.0"
    assert matcher.explained(found, by_weight=True).where("doc_id = 0").first()["rules"].startswith("ab 0.266722; abc")


def test_wildcards_match_one_token(spark):
    made = spark.createDataFrame([(0, "a * c", ["a", "*", "c"], 1.0), (1, "b", ["b"], 2.0)], "feature_id int, pattern string, tokens array<string>, weight double")
    tests = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "c"]), (3, ["a", "x", "y", "c"]), (4, None)], "doc_id long, tokens array<string>")
    assert sorted((r["doc_id"], r["feature_id"]) for r in matcher.matches(tests, made).collect()) == [(1, 0), (1, 1)]
    assert matcher.matches(tests, made.limit(0)).count() == 0
    assert matcher.prefixes_of(tests, made).count() == 0


def test_bounds_hold_for_all_extensions(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.choice([-1, 1])), list(rng.choice(list("abc"), size=rng.integers(1, 6))), float(rng.normal())) for i in range(30)]
    frame = spark.createDataFrame([(i, y, [str(t) for t in x], s) for i, y, x, s in rows], "doc_id long, y int, tokens array<string>, score double")
    for objective in (0, 2):
        grads = gradient.gradients(pattern_docs(frame, 1, 4), frame.select("doc_id", "y", "score"), objective)
        coef = spark.createDataFrame([(["a", "b"], 0.7), (["c"], -0.4)], "pattern array<string>, beta double")
        got = {tuple(r["pattern"]): r for r in gradient.prefix_bounds(gradient.regularised(grads, coef), coef).collect()}
        for p, r in got.items():
            for q, o in got.items():
                if q[: len(p)] == p:
                    assert abs(o["gradient"]) <= r["bound"] + 1e-9
        top = gradient.best(gradient.regularised(grads, coef)).first()
        assert abs(abs(top["gradient"]) - max(abs(r["gradient"]) for r in got.values())) < 1e-9


def test_losses_on_groups_and_in_place(spark, monkeypatch):
    marked = spark.createDataFrame([(1, 0.5, True), (-1, 0.5, True), (-1, -2.0, False), (1, 0.5, True)], "y int, score double, has boolean")
    for objective in (0, 2):
        held = linesearch.Losses(marked, objective)
        monkeypatch.setattr(linesearch, "GROUPS", 0)
        apart = linesearch.Losses(marked, objective)
        monkeypatch.undo()
        assert held.groups is not None and apart.groups is None
        points = [(1.0, 0.0), (0.5, 0.3), (0.0, -4.0)]
        assert np.allclose(held(points), apart(points)) and held.sizes() == apart.sizes() == (2.0, 3.0)
        best = linesearch.exact_step(held, held([(1.0, 1e-6)])[0] - held([(1.0, 0.0)])[0], lambda s: s * s)
        near = held([(1.0, best), (1.0, best + 1e-3), (1.0, best - 1e-3)])
        assert near[0] + best**2 <= min(near[1] + (best + 1e-3) ** 2, near[2] + (best - 1e-3) ** 2)


def test_extreme_scores(spark):
    frame = spark.createDataFrame([(1, -1e5), (1, 1e5), (-1, 1e5)], "y int, score double")
    got = frame.select(loss(frame.y, frame.score).alias("l"), probability(frame.score).alias("p")).collect()
    assert [r["l"] for r in got] == [1e5, 0.0, 1e5] and [r["p"] for r in got] == [0.0, 1.0, 1.0]
    assert linesearch.total_loss(frame.limit(0)).first()["loss"] == 0.0


def test_registered_learners_run_to_their_stop_tests(spark, monkeypatch):
    from gramloom.plans import reference

    seen = []
    monkeypatch.setattr(reference, "_docs", lambda *a: None)
    monkeypatch.setattr(reference, "_LEARNED", {})
    monkeypatch.setattr(reference.learner, "learn", lambda docs, params: seen.append(params) or learner.Learned())
    for query in (reference.learn_word, reference.learn_char, reference.learn_log):
        query(spark, "")
    # words are learned once for both queries
    assert [p.token for p in seen] == ["word", "char"]
    assert all((p.maxitr, p.convergence, p.maxpat) == (5000, 0.005, None) for p in seen)


def test_what_was_learned_is_checked_another_way(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 1 if i % 2 else -1, " ".join(rng.choice(list("abcd") if i % 2 else list("abce"), size=6))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, y int, text string")
    params = Params(token="word", minsup=2, maxitr=6)
    got = learn(frame, params)
    assert len(got.steps) > 2 and all(v for k, v in learner.checked(frame, got, params).items() if k != "stopped")
    wrong = learner.Learned([(i, d * 1.1, p) for i, d, p in got.steps], got.log)
    assert not learner.checked(frame, wrong, params)["loss_agrees"]
    worse = learner.Learned(got.steps, [*got.log[:-1], {**got.log[-1], "gradient": 0.0}])
    assert not learner.checked(frame, worse, params)["best_found"]
    assert all(learner.checked(frame.limit(0), learner.Learned(), params).values())
