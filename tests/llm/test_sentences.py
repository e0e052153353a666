import itertools
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from gramloom.llm import catalogue
from gramloom.llm import sentences as S

TEXTS = [t[: S.SAMPLE_CHARS] for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
MODEL = S.train(TEXTS)

CASES = [
    ["Dr. Orla kept it.", "At 9 a.m. the fold began.", "It ended at 7 p.m.", "The rest is lost."],
    ["J. P. Kai of Quadra Inc. sent 43 lines, cf. Fig. 3 of vol. 12.", "Why?!", "See no. 5."],
    ["He waited ... and went on.", "It came before step 5...", "Then it stopped.", "Oh no… the index is gone."],
    ['K. Ox asked, "Why was it cut? It had support." and got no reply.', '"Stop it. Now."', "Who?", 'Who wrote "keep it." here?'],
    ["Lalland et al. found it.", "It covers dra.", "¿A qué?", "x was never scored.", "See Lalland et al.", "The end."],
    ["Weights such as .5 or -0.04 are normal.", "mRNA tags, e.g. x, carry none.", "pH-like scores fell by 0.09%.", "(They agreed.)", "See http://a.invalid/x?id=3 now."],
    ["Did J. Ox say 'stop it!' or 'leave it'?", "It printed 'no', etc., and died.", "The note (see sec. 2.4) is out."],
    ["„Die Schranke ist lose. Sie hält“, schrieb A. Ox.", "„Neu starten!“", "Am 3. Mai, d. h. bald, z. B. im Juni.", "Das gilt bzw. galt.", "Der Wert ist 0,5.", "Siehe S. 4 ff. im Text."],
    ["« Relancez tout ! »", "« La borne. Elle tient », écrit Mme Ox.", "Est-ce « rare » ?", "Voir p. ex. fig. 3."],
    ["La Sra. Ox anotó: «El límite es flojo. Pero sirve» en el acta.", "¿Y ahora?", "¡Nadie!", "Vale."],
    ["Проф. Ox оставил метку, т. е. образец.", "В 2019 г. метод был.", "«Граница. Но верна», — пишет он.", "И. О. Ox и т. д. по списку."],
    ["Ποιος το μέτρησε;", "Ο κ. Βρένης έγραψε, π.χ. το xa.", "Δύο μένουν· ο τρίτος έφυγε."],
    ["डॉ. वरेन ने रखा।", 'लिखा है, "सीमा है। सही है।" और काम चला।', "कृ. पृ. 4 देखें।"],
    ["هل نعيد المحاولة؟", "كتب الفريق: «الحد ضعيف. لكنه صحيح.» في السجل.", "القيمة 0.5، انظر ص. 4."],
    ["ዶ/ር ብሬን ቆየ።", "ለምን ተቆረጠ፧", "ለምን?"],
    ["Տե՛ս էջ 5, նկ. 3 մեջ։", "«Սահմանը թույլ է։ Բայց ճիշտ է» գրել է խումբը։", "Ինչո՞ւ հեռացվեց։"],
    ["กฎต่าง ๆ ถูกตัดออกไปหมด", "คำว่า split ปรากฏใน 163 ลำดับ", "รุ่น 3.8 อ่านแฟ้ม"],
]
JOINED = [
    ["标签为0的行不算正例。", "真的吗？！", "有人写道：“不可靠！真的。”但没有证据。", "（详见附录。）", "覆盖了3条……其余没有。", "版本2.2.3会读。"],
    ["本当に？", "「もう一度やろう！」と言った。", "図8を参照……詳細は次。", "損失は0.5まで下がった。"],
    ["It is rare.", "The end came.", "He left."],
]


def cut(text):
    return [text[a:b] for a, b in S.split(text, MODEL)]


@pytest.mark.parametrize("want", CASES, ids=lambda c: c[0][:12])
def test_sentences(want):
    assert cut(" ".join(want)) == want
    assert cut("  ".join(want) + "\n\n" + "\n".join(want)) == want + want
    wrapped = " ".join(want).replace(" ", "\n")
    if not any("ๆ" in w for w in want):
        assert [" ".join(x.split()) for x in cut(wrapped)] == want


@pytest.mark.parametrize("want", JOINED, ids=lambda c: c[0][:6])
def test_missing_blanks(want):
    assert cut("".join(want)) == want


def test_blocks_and_lists():
    text = "2. Data and labels\n\nNo mark here\n \nOne. Two.\n- drop label 0. Now\n3) keep i.e. all\nThree.\n\tFour.  \n"
    assert cut(text) == ["2. Data and labels", "No mark here", "One.", "Two.", "- drop label 0. Now", "3) keep i.e. all", "Three.", "Four."]
    assert cut("Cut off in the mid") == ["Cut off in the mid"] and cut(' "Open. And') == ['"Open. And']


@pytest.mark.parametrize("text", [None, "", " \n\n\t ", " 　"])
def test_no_sentences(text):
    assert S.split(text, MODEL) == []


def test_all_text_is_covered_once():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab C.!?…\"'“”«»„「」。।;()-1 \n\n5กๆ") for _ in range(120))
        got = S.split(text, MODEL)
        assert "".join("".join(text[a:b].split()) for a, b in got) == "".join(text.split())
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def chain_score(found, tags, moves):
    score, before, last = 0.0, 1, 0
    for (end, own), tag in zip(found, tags):
        score += moves[before][tag][S._spot(end, last)] + own * tag
        before, last = tag, end
    return score


def test_viterbi_is_best():
    rng = random.Random(2)
    for _ in range(100):
        found, at = [], 0
        moves = [[[rng.uniform(-1, 1) for _ in range(4)] for _ in range(2)] for _ in range(2)]
        for _ in range(7):
            at += rng.randint(1, 20)
            found.append((at, rng.uniform(-1, 1)))
        best = max(itertools.product((0, 1), repeat=7), key=lambda tags: chain_score(found, tags, moves))
        assert S.decode(found, moves) == [e for (e, _), tag in zip(found, best) if tag]


def test_places_that_no_neighbour_changes_are_decided_alone(monkeypatch):
    rng, alone = random.Random(12), 0
    for spread in (2, 6, 20):
        for _ in range(150):
            found, at = [], 0
            moves = [[[rng.uniform(-1, 1) for _ in range(3)] + [0.0] for _ in range(2)] for _ in range(2)]
            for _ in range(rng.randint(0, 6)):
                at += rng.randint(1, 20)
                found.append((at, rng.uniform(-spread, spread)))
            best = max(itertools.product((0, 1), repeat=len(found)), key=lambda tags: chain_score(found, tags, moves))
            assert S.decode(found, moves) == [e for (e, _), tag in zip(found, best) if tag]
            low, high = S._bounds(moves)
            alone += bool(found) and all(s < low or s > high for _, s in found)
    assert 50 < alone < 400


def test_marginals_are_sums_over_all_tags():
    rng = random.Random(3)
    key = lambda i: (".", "word", str(i), "upper", "", True, "")
    chains = []
    for n in (1, 4, 6):
        at, chain = 0, []
        for i in range(n):
            at += rng.randint(1, 20)
            chain.append((at, key(i), rng.choice([0, 1, None])))
        chains.append(chain)
    data = S._Chains(chains)
    scores = np.array([0.0, *(rng.uniform(-1, 1) for _ in data.keys)])
    moves = np.array([[[rng.uniform(-1, 1) for _ in range(3)] + [0.0] for _ in range(2)] for _ in range(2)])
    for barred in (None, data.barred):
        got, expected = data.marginals(scores, moves, barred)
        want = np.zeros((2, 2, 4))
        for c, chain in enumerate(sorted(chains, key=len, reverse=True)):
            found = [(e, scores[data.keys.index(k) + 1]) for e, k, _ in chain]
            ways = [t for t in itertools.product((0, 1), repeat=len(chain)) if barred is None or all(x in (None, y) for (_, _, x), y in zip(chain, t))]
            each = np.exp([chain_score(found, t, moves) for t in ways])
            for i in range(len(chain)):
                assert got[i, c] == pytest.approx(each[[t[i] == 1 for t in ways]].sum() / each.sum())
            for t, p in zip(ways, each / each.sum()):
                before, last = 1, 0
                for (end, _), tag in zip(found, t):
                    want[before, tag, S._spot(end, last)] += p
                    before, last = tag, end
        assert expected == pytest.approx(want)


def rows(model, texts=TEXTS):
    return {(i, *x) for i, t in enumerate(texts) for x in S.split(t, model)}


def test_training_and_viterbi_decide(monkeypatch):
    full = rows(MODEL)
    bare = rows(S.Model(before=MODEL.before, after=MODEL.after))
    assert len(full & bare) < 0.6 * len(full)
    thai = [i for i, t in enumerate(TEXTS) if S._HAS_THAI.search(t)]
    blanks = S.Model({k: w for k, w in MODEL.weights.items() if not k.startswith("b")}, MODEL.transitions, MODEL.before, MODEL.after)
    assert len([x for x in rows(blanks) & full if x[0] in thai]) < 0.6 * len([x for x in full if x[0] in thai])
    monkeypatch.setattr(S, "decode", lambda found, _: [e for e, s in found if s > 0])
    assert rows(MODEL) != full


def test_most_sentences_are_found_without_any_list(monkeypatch):
    full = rows(MODEL)
    for name in ("TITLES", "NEVER", "MAYBE", "MONTHS", "DAYS"):
        monkeypatch.setattr(S, name, set())
    monkeypatch.setattr(S, "AFTER", {})
    got = rows(S.train(TEXTS))
    assert len(got & full) > 0.95 * len(full) and len(got & full) > 0.93 * len(got)


def test_a_model_of_the_seeds_alone():
    model = S.train([None, "", " "])
    hits = [sum(text in [t[a:b] for a, b in S.split(t, model)] for text in want) / len(want) for want in CASES for t in [" ".join(want)]]
    assert sum(hits) / len(hits) > 0.8


def test_training_is_repeatable():
    one, two = S.train(TEXTS[:50]), S.train(TEXTS[:50])
    assert one.weights == two.weights and one.transitions == two.transitions


def test_the_sample_does_not_depend_on_partitions(spark):
    frame = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(1, "text 1"), (None, "x"), (500, None), (501, "")], "doc_id long, text string")
    one, two = S.sample(frame.repartition(7), 100), S.sample(frame.coalesce(1), 100)
    assert one == two and 100 <= len(one) <= 101
    assert S.sample(frame.where("doc_id > 499")) == []


def test_long_text_is_fast_and_whole():
    text = "The rule holds. " * 20_000
    assert len(S.split(text, MODEL)) == 20_000


def test_frame(spark):
    rows = [(1, "One. Two."), (2, None), (None, "Three."), (1, "One. Two.")]
    got = [tuple(r) for r in S.sentences(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 4), (1, 5, 9), (None, 0, 6), (1, 0, 4), (1, 5, 9)], key=str)
    assert S.sentences(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_the_model_comes_from_all_documents(spark, tmp_path):
    # an abbreviation that no list has, in one of 1,900 documents and behind 30,000 characters of its text
    word = "zq"
    rare = "The rule holds. " * 2_000 + " ".join(f"It is of {word}. size {i} here." for i in range(60))
    texts = ["One rule holds. Two fail."] * 1_900 + [rare]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = S.fitted(spark, frame)
    assert model.before[word].startswith("always most") and any(f.startswith(f".p {word}") for f in model.weights)
    want = S.train(texts)
    assert (model.before, model.after) == (want.before, want.after) and set(model.weights) == set(want.weights)
    assert [model.weights[f] for f in want.weights] == pytest.approx(list(want.weights.values()), abs=1e-6)
    assert np.array(model.transitions) == pytest.approx(np.array(want.transitions), abs=1e-6)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["sent_start"], r["sent_end"]) for r in catalogue.p10_found(spark, str(tmp_path)).collect()}
    assert got == {(i, *x) for i, t in enumerate(texts) for x in S.split(t, want)}


def test_slopes_in_slices_are_the_same(spark, monkeypatch):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:60])], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(S, "PASSES", 4)
    whole = S.fitted(spark, frame)
    for name, value in (("SLICE", 100), ("DIRECT", 0), ("PART", 500)):
        monkeypatch.setattr(S, name, value)
    parts = S.fitted(spark, frame)
    assert set(whole.weights) == set(parts.weights) and [parts.weights[f] for f in whole.weights] == pytest.approx(list(whole.weights.values()), abs=1e-6)


def test_sums_of_ratios_are_those_of_scores():
    rng = random.Random(8)
    chains = [[(10 * i + rng.randint(1, 9), (".", "word", str(rng.randint(0, 9)), "upper", "", True, ""), rng.choice([0, 1, None])) for i in range(n)] for n in (1, 2, 5, 40)]
    data = S._Chains(chains)
    scores = np.array([0.0, *(rng.uniform(-3, 3) for _ in data.keys)])
    moves = np.array([[[rng.uniform(-1, 1) for _ in range(3)] + [0.0] for _ in range(2)] for _ in range(2)])
    ratios, inside = np.exp(scores)[data.row], data.spot != S._OUTSIDE
    for barred, own in ((None, ratios), (data.barred, np.where(data.tag == 2, ratios, np.where(data.tag == 1, 1e60, 0.0)))):
        want = data.marginals(scores, moves, barred)
        ((there, spot, x),) = S._stepped(data.spot, own)
        got = S._sums(x, there, spot, moves)
        assert got[0] == pytest.approx(want[0][inside], abs=1e-9) and got[1] == pytest.approx(want[1], abs=1e-9)


def test_empty_documents_leave_the_seeds(spark):
    frame = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert set(S.fitted(spark, frame).weights) == set(S.train([]).weights)


def test_passes_run_on_compact_parts_in_few_tasks(spark, monkeypatch):
    # descriptions that differ only in words too rare for features are one, a place takes two bytes, and a task has several parts
    texts = [f"It is of w{i}. The rule holds. Size {i}.5 is it. {t}" for i, t in enumerate(TEXTS[:300])]
    want, tasks = S.train(texts), []
    part, found, times = S._named(want, S.examples(want, texts))
    keys, size = part.n_keys, sum(len(x) for _, x in part.blocks)
    names = sorted(f for f, n in zip(found, times) if n >= 3)
    part.number(found, {f: i for i, f in enumerate(names)})
    assert part.n_keys < 0.8 * keys and {x.dtype for _, x in part.blocks} == {np.dtype(np.uint16)} and sum(len(x) for _, x in part.blocks) == size
    monkeypatch.setattr(S, "PART", 500)
    slope = S._slope
    monkeypatch.setattr(S, "_slope", lambda rows, n, *x: tasks.append((rows.count(), n)) or slope(rows, n, *x))
    got = S.fitted(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9))
    assert len(tasks) == S.PASSES and all(n <= -(-parts // S.PARTS_EACH) and parts > 9 for parts, n in tasks)
    assert set(got.weights) == set(want.weights) and [got.weights[f] for f in want.weights] == pytest.approx(list(want.weights.values()), abs=1e-6)


def test_sentences_of_repeated_ids_come_once(spark, tmp_path, monkeypatch):
    rows = [(1, "One. Two."), (1, "One. Two."), (2, "One. Two."), (1, "One. It."), (None, "Three."), (None, "Three."), (None, "Four it is."), (3, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted([(1, 0, 4), (1, 5, 9), (1, 5, 8), (2, 0, 4), (2, 5, 9), (None, 0, 6), (None, 0, 11)], key=str)
    assert sorted([tuple(r) for r in catalogue.p10_found(spark, str(tmp_path)).collect()], key=str) == want
    monkeypatch.setattr(S, "BROADCAST_ROWS", 1)
    assert sorted([tuple(r) for r in catalogue.p10_found(spark, str(tmp_path)).collect()], key=str) == want


def test_blocks_and_lists_as_line_by_line():
    def units(text):
        start, at = None, 0
        for line in text.split("\n"):
            is_list = S.re.match(r"[^\S\n]*(?:- |\d+\) )", line)
            if is_list or not line.strip():
                if start is not None:
                    yield start, at, False
                if is_list:
                    yield at, at + len(line), True
                start = None
            elif start is None:
                start = at
            at += len(line) + 1
        if start is not None:
            yield start, len(text), False

    rng = random.Random(9)
    for _ in range(3_000):
        text = "".join(rng.choice(["a", "- ", "1) ", " ", "\t", "\n", "\n", "\x1f", " ", "\r"]) for _ in range(rng.randint(0, 12)))
        assert list(S.units(text)) == list(units(text)), text
