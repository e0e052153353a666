import pytest

from gramloom.__main__ import main, parser

TRAIN = {"1": "+1 ab \r\n+1 abcd \r\n-1 abd \r\n-1 bcd \r\n", "0": "+1 a b \r\n+1 a b c d \r\n-1 a b d \r\n-1 b c d \r\n"}
TEST = {"1": "+1 abc\r\n+1 ada\r\n-1 bda\r\n-1 bc\r\n", "0": "+1 a b c\r\n+1 a d a\r\n-1 b d a\r\n-1 b c\r\n"}


def run(spark, *args):
    lines = []
    main([str(a) for a in args], spark, lines.append)
    return lines


@pytest.mark.parametrize("n", ["1", "0"])
def test_whole_chain(spark, tmp_path, n):
    (tmp_path / "train").write_text(TRAIN[n], newline="")
    (tmp_path / "test").write_text(TEST[n], newline="")
    steps, made, predictors = tmp_path / "steps", tmp_path / "model", tmp_path / "predictors"
    assert run(spark, "learn", "-n", n, "-L", 4, "-r", 1, "--compat", tmp_path / "train", steps)[-1] == "steps: 8"
    assert run(spark, "mkmodel", "-n", n, "-i", steps, "-o", made, "-O", predictors)[0].startswith("features: 7")
    lines = [r[0] for r in spark.read.text(str(predictors)).collect()]
    assert float(lines[0]) == pytest.approx(-0.0125687771804646) and lines[1].split(" ", 1)[1].replace(" ", "") == "ab"
    got = dict(x.split(": ") for x in run(spark, "tune", "-n", n, tmp_path / "train", made))
    assert round(float(got["best_threshold"]), 7) == 0.0746284 and got["min_errors"] == "0"
    lines = run(spark, "classify", "-n", n, "-v", 2, tmp_path / "test", made)
    assert lines[0].startswith("1 0.68621") and lines[0].endswith(" a b c" if n == "0" else " abc")
    got = dict(x.split(": ") for x in lines[4:])
    lines4 = run(spark, "classify", "-n", n, "-v", 4, tmp_path / "test", made)[0].split("\n")
    assert lines4[0] == "<instance>" and lines4[-1] == "</instance>" and lines4[1].startswith("1 0.68621")
    assert lines4[2].startswith("rule: -0.01256877") and lines4[2].endswith(" __DFAULT__")
    assert [x.split(" ", 1)[1].rsplit(" ", 1)[0].replace(" ", "") for x in lines4[3:-1]] == ["a", "ab", "abc"]
    assert run(spark, "classify", "-n", n, "-v", 3, tmp_path / "test", made)[:2][0] == "Test doc out of vocabulary"
    assert run(spark, "classify", "-n", n, "-v", 5, tmp_path / "test", made)[1] == "1 1:1.0 7:1.0"
    tuned = run(spark, "tune", "-n", n, "-v", 3, tmp_path / "train", made)
    assert tuned[0].split("\n")[3].startswith("rule: a b" if n == "0" else "rule: ab") and tuned[-1].startswith("best_threshold")
    assert len(run(spark, "tune", "-n", n, "-v", 1, tmp_path / "train", made)[0].split(" ")) == 3
    assert float(got["accuracy"]) == 75 and float(got["auc"]) == 75 and float(got["auc50"]) == pytest.approx(3) and got["oov_docs"] == "1"


def test_standard_input_is_stored_in_parts(spark, tmp_path):
    from gramloom.sources import sequences

    got = sequences.stored_lines(spark, (f"{i % 2} x\n" for i in range(25)), str(tmp_path / "in"), 10)
    assert sorted((r["line_no"], r["value"]) for r in got.collect()) == [(i, f"{i % 2} x") for i in range(25)]
    assert sequences.stored_lines(spark, [], str(tmp_path / "none")).count() == 0


def test_learning_from_standard_input(spark, tmp_path, monkeypatch):
    import io

    monkeypatch.setattr("sys.stdin", io.StringIO(TRAIN["1"]))
    lines = run(spark, "learn", "-r", 1, "--compat", "-v", 2, "-", tmp_path / "steps")
    assert lines[-1] == "steps: 8" and lines[0].startswith("parameters:") and lines[1].split()[3] == "0.193875000000"


def test_options_are_checked():
    with pytest.raises(SystemExit):
        parser().parse_args(["learn", "-o", "1", "a", "b"])
    with pytest.raises(SystemExit):
        parser().parse_args(["mkmodel", "-i", "a"])
