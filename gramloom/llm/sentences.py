"""Sentence boundaries across languages and scripts, by a linear-chain model.

Every character is either the last of a sentence (boundary) or inside one. Only after end marks, after the closing mark of a
quotation that an end mark precedes, and at blanks next to letters of a script written without end marks can a boundary be; all other characters are inside, so the
chain is decoded over these places alone, with Viterbi's algorithm.

A place is described by its mark, what stands before and after it (kind of token, case, script, blank), whether a quotation is open, and how the words next to it behave in
the documents. The weights of these features, and of the tags' transitions by distance, are learned from all documents as a conditional random
field over partly labelled chains: paragraphs are joined with their breaks taken out, so that the places of the breaks are known boundaries; places which the definition of
a sentence settles are labelled, all others are left open and summed over. Text of a script without end marks is stripped of punctuation first. A few labelled sentences
(``seeds``) are always among the examples. Nothing but the learned model decides when texts are split.
"""

from __future__ import annotations

import gc
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramloom.llm.seeds import SEEDS
from gramloom.llm.tokens import uniform
from gramloom.tables import cut

#: Documents, and characters of each, of a ``sample``.
SAMPLE, SAMPLE_CHARS = 1_000, 20_000
#: Places that are held as one part in training, values of a slope that are added up at once, and values in all up to which that is done by the driver.
PART, SLICE, DIRECT = 200_000, 50_000, 8_000_000
#: Stretches whose sums are worked out at once.
WIDE = 4_096
#: Places in a stretch of a chain, passes over all stretches, and the weight of the squared weights in training.
STRETCH, PASSES, RIDGE = 32, 60, 0.02
#: Tokens, and descriptions of places, that a task keeps what it worked out about.
KNOWN = 200_000
#: Parts in a task of a pass, about.
PARTS_EACH = 8
#: Repeated ids of documents (some 30 bytes each) up to which they are broadcast; beyond, all sentences are shuffled.
BROADCAST_ROWS = 1_000_000

# Titles and the like, written with a capital; a name follows their point.
TITLES = set("Dr Mr Mrs Ms Prof St Mt Capt Sgt Hr Fr Mme Mlle Sr Sra Srta Dra EE Проф См Акад".split())
# Abbreviations whose point never ends a sentence (a name or a phrase follows), lower case.
NEVER = set("cf vs e.g i.e bzw z.b d.h u.a sog p.ex p.ej см им акад т.е κ βλ κα π.χ डॉ कृ पृ श्री".split())
# The same, but only after the token given.
AFTER = {"ex": "p.", "ej": "p."}
# Abbreviations after which a sentence may be over; not before a number or a lower-case letter.
MAYBE = set(
    "etc al a.m p.m inc ltd co corp jr no nos vol fig figs ch sec sect pp eq approx max min ed eds gen rev u.s u.k ph.d "
    "ff usw nr ca evtl ggf vgl abb kap tab env chap art pág págs aprox cap núm "
    "рис стр тыс ул гл напр д т.д т.п п г гг др млн млрд руб σελ σχ αρ κ.λπ κλπ նկ էջ".split()
)
# Months, which follow a day's number and point, and words before such numbers.
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
DAYS = set("am vom zum bis den dem der im".split())

_STRONG = "!?！？؟。।॥።፧։"
_STRONG_MARKS = frozenset(_STRONG)
_FULL = "！？。।॥።፧։؟"
_MARKS = _STRONG + "….;;"
_CLOSERS = "\"'”’»)]」』）“"
_OPENERS = "\"'“„«([「『（‘‚¿¡"
_CLOSE = {'"': '"', "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‘": "’", "‚": "‘’", "'": "'"}
_THAI = r"[ก-ฺเ-ๅ็-๎]"
# one set of characters comes first, so that the search skips all others quickly
_TAIL = (
    r"(?:(?<=[“„«「『‘‚])|(?<=\")(?<![^\s(\[,:，：]\")|(?<=')(?<![^\s(\[]')(?=\S)"
    r"|(?<=[.!?！？؟。।॥።፧։…;\u037E])[.…!?！？؟。]*"
)
_FIRST = r"“„«「『‘‚\"'.!?！？؟。।॥።፧։…;\u037E"
_SCAN = re.compile(rf"[{_FIRST}]{_TAIL})")
_SCAN_THAI = re.compile(rf"[ {_FIRST}]{_TAIL}|(?<= ) *(?=\S))")
_INNER = re.compile(r"[.!?！？؟。।॥።፧։…]+")
_HAS_THAI = re.compile(_THAI)
_QUOTES = re.compile(r"[\"“”„«»「」]")
_SINGLE = re.compile(r"(?<=\S)'(?!\w)")
_DOTTED = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]+")
_NUMBER = re.compile(r"[-+]?\d[\d.,]*%?")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_GOES_ON = re.compile(r"[؀-ۿऀ-ॿ぀-ヿ㐀-鿿豈-﫿＀-￯。！？।]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
#: A list line, or a blank one.
_BREAK = re.compile(r"^[^\S\n]*+(?:(- |\d+\) ).*|$)", re.MULTILINE)
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_ASCII_SPACES = [c for c in _SPACES if c.isascii()]
_PUNCTUATION = re.compile(r"[!?…;:,\"“”'()]|\.(?!\d)")
_NUMBERED = re.compile(r"\d+\. ")
_TOKENS = re.compile(r"[^\s.!?…,;:]+(?:\.[^\s.!?…,;:]+)*")
_POINT_OR_NOT = re.compile(_TOKENS.pattern + r"\.?")
#: What follows a place, behind blanks and opening marks: a word, another character, or nothing.
_FOLLOWING = re.compile(rf" *[{re.escape(_OPENERS)}]*([^\W\d_]+|.)?", re.DOTALL)
#: Characters since the place before: close, near, far; after the end of a chain nothing is scored.
_CLOSE_BY, _NEAR, _FAR, _OUTSIDE = range(4)

Key = tuple[str, str, str, str, str, bool, str]


def _flat(text: str) -> str:
    """The text with blanks for all white space; places stay the same."""
    for c in _ASCII_SPACES if text.isascii() else _SPACES:
        text = text.replace(c, " ")
    return text


class _Kept(dict):
    """What a function gives, worked out once for each of up to ``KNOWN`` values."""

    def __init__(self, of: Callable) -> None:
        self.of = of

    def __missing__(self, value: object) -> object:
        found = self.of(value)
        if len(self) < KNOWN:
            self[value] = found
        return found


class Known:
    """What follows from pieces of text alone: kinds of tokens, shapes of what follows places, and descriptions of points within numbers and the like."""

    def __init__(self) -> None:
        self.kinds, self.shapes, self.glued = _Kept(_kind), _Kept(_shape), _Kept(_glued)


@dataclass
class Model:
    """Learned weights of features and transitions (tag before, tag, distance), and how words behave: see :func:`behaviour`."""

    weights: dict[str, float] = field(default_factory=dict)
    transitions: list = field(default_factory=lambda: np.zeros((2, 2, 4)).tolist())
    before: dict[str, str] = field(default_factory=dict)
    after: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.scores, self.labels, self.known = _Kept(self.score), _Kept(lambda key: settled(self, key)), Known()

    def score(self, key: Key) -> float:
        """How much more a place looks like a boundary than like an inside."""
        weight = self.weights.get
        return sum([weight(f, 0.0) for f in features(self, key)])


def units(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is it a list line) of the parts that no sentence crosses: paragraphs between blank lines, and list lines."""
    start, n = 0, len(text)
    for m in _BREAK.finditer(text):
        a, b = m.span()
        if start < a:
            yield start, a, False
        if m[1]:
            yield a, b, True
        start = b + 1
    if start < n:
        yield start, n, False


def _shape(c: str | None) -> tuple[str, str]:
    """(kind, word) of what follows a place: upper, lower, mixed (mRNA), digit, other letters, punctuation or none. ``c``: a word or another character."""
    if not c:
        return "none", ""
    if c[0].isalpha():
        if c[0].isupper():
            return "upper", c
        if c[0].islower():
            return ("mixed" if c[1:2].isupper() or c[2:3].isupper() else "lower"), c
        return "letter", c
    return ("digit", "") if c[0].isdigit() else ("punct", c[0])


def _kind(token: str, after: bool | None = None) -> tuple[str, str]:
    """(kind, token) of the token before a point: never, maybe, initial, integer, number, word or none. ``after``: whether the word that ``AFTER`` asks for is before the
    token; "after" is given where that decides and is not told."""
    low = token.lower()
    if low in MAYBE:
        return "maybe", low
    if token in TITLES or low in NEVER or low in AFTER and after:
        return "never", low
    if low in AFTER and after is None:
        return "after", low
    if len(token) == 1 and token.isalpha():
        return "initial", low
    if not token:
        return "none", ""
    if _NUMBER.fullmatch(token):
        return ("integer" if token.isdigit() else "number"), ""
    if _DOTTED.fullmatch(token):
        last = token.rsplit(".", 1)[1]
        return ("maybe" if len(last) == 1 else "word"), low
    return "word", low


def _glued(three: str) -> Key | None:
    """The description of a point by the three characters behind it, if the first is a digit or starts a word in lower case."""
    m = _FOLLOWING.match(three)[1] if three[:1].isalnum() else None
    shape = _shape(m)[0]
    return (".", "glued", "", shape, "", False, "") if shape in ("digit", "lower") else None


def _next(p: str, j: int, known: Known) -> tuple[str, str, bool]:
    """(shape, word, blank between) of what follows a place."""
    return *known.shapes[_FOLLOWING.match(p, j)[1]], j >= len(p) or p[j] == " "


def _side(c: str) -> str:
    """The class of a character next to a blank of a script without end marks."""
    if "ก" <= c <= "๎":
        return "again" if c == "ๆ" else "own"
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "mark"


def places(p: str, known: Known) -> Iterator[tuple[int, Key]]:
    """(end of a possible sentence, description) over a paragraph whose white space is blanks."""
    at, since, n = 0, 0, len(p)
    kinds, shapes, glued, follows = known.kinds, known.shapes, known.glued, _FOLLOWING.match
    scan = (_SCAN_THAI if _HAS_THAI.search(p) else _SCAN).search
    while found := scan(p, at):
        i, j = found.span()
        mark = p[i]
        if mark == "." and j == i + 1:
            key = glued[p[j : j + 3]]
            if key:
                at = j
                yield j, key
                continue
        if mark in _CLOSE:
            if mark == "'":
                shut = _SINGLE.search(p, j)
                k = shut.start() if shut else -1
            else:
                ends = [x for x in (p.find(c, j) for c in _CLOSE[mark]) if x >= 0]
                k = min(ends) if ends else -1
            if k < 0 and mark in "'‘‚":
                at = j
                continue
            last = k if k >= 0 else n
            while last > i and p[last - 1] == " ":
                last -= 1
            for inner in _INNER.finditer(p, j, last):
                if inner.end() < last:
                    shape, word, blank = _next(p, inner.end(), known)
                    yield inner.end(), ("inner", "", inner.group()[-1], shape, "", blank, "open" if k < 0 else "shut")
            if k < 0:
                return  # open to the end of the paragraph
            at = j = k + 1
            if last - 1 <= i or p[last - 1] not in _MARKS:
                continue
            while j < n and p[j] in _CLOSERS and not (p[j] in "\"'“" and j + 1 < n and p[j + 1].isalnum()):
                j += 1
            b = last - 1
            while b > i and p[b] in _MARKS:
                b -= 1
            at = j
            key = ("close", "", "", *_next(p, j, known), "on" if _GOES_ON.match(p[b]) or _GOES_ON.match(p[last - 1]) else "")
        elif mark == " ":
            at = j
            one, two = _side(p[i - 1]) if i else "mark", _side(p[j]) if j < n else "mark"
            if "own" not in (one, two) and "again" not in (one, two):
                continue
            key = ("blank", one, p[max(0, i - 4) : i] if one == "own" else "", two, p[j : j + 4] if two == "own" else "", True, "")
            j = i
        else:
            mark, at = p[i:j], j
            while j < n and p[j] in _CLOSERS and not (p[j] in "\"'“" and j + 1 < n and p[j + 1].isalnum()):
                j += 1
            shape, word = shapes[follows(p, j)[1]]
            blank = j >= n or p[j] == " "
            if mark == "." or mark == "\u037e":
                if not blank and (shape == "digit" or shape == "lower") and j == i + 1:
                    at = j
                    yield j, (".", "glued", "", shape, "", False, "")
                    continue
                token = p[p.rfind(" ", since, i) + 1 or since : i].lstrip(_OPENERS)
                kind, low = kinds[token]
                extra = ""
                if kind == "after":
                    kind, low = _kind(token, p.endswith(AFTER[low] + " " + token, 0, i))
                elif kind == "integer" and shape != "none":
                    b = i - len(token)
                    while b > 0 and p[b - 1] == " ":
                        b -= 1
                    extra = "day" if word.lower() in MONTHS or p[p.rfind(" ", 0, b) + 1 : b].lower() in DAYS else ""
                key = (".", kind, low, shape, word, blank, extra)
                # the next token starts here, unless this point is one inside a short token
                if not blank and len(low) < 3 and kind != "integer":
                    at = j
                    yield j, key
                    continue
            elif mark[0] in ";;":
                if mark[0] == ";" and not _GREEK.search(p, since, i):
                    at = i + 1
                    continue
                key = ("greek", "", "", shape, word, blank, "")
            elif not _STRONG_MARKS.isdisjoint(mark):
                key = ("strong", "", "", shape, word, blank, "full" if mark[-1] in _FULL else "")
            else:
                b = i
                while b > 0 and p[b - 1] == " ":
                    b -= 1
                key = ("ellipsis", "", "", shape, word, blank, "cjk" if b > 0 and _CJK.match(p[b - 1]) else "")
            at = since = j
        yield j, key


class _Tally:
    """Counts of runs between blanks, of runs that end with a point by what follows, and of runs at the start of paragraphs: equal ones are looked at once."""

    def __init__(self) -> None:
        self.runs, self.ends, self.firsts = Counter(), Counter(), Counter()

    def add(self, paragraphs: list[str]) -> None:
        """Takes in paragraphs whose white space is blanks, none of it outside."""
        self.runs.update(" ".join(paragraphs).split())
        self.firsts.update([p.partition(" ")[0] for p in paragraphs])
        ends = []
        for p in paragraphs:
            # each piece but the last ends with a point and a blank
            pieces = f"{p} ".split(". ")
            if len(pieces) > 1:
                for x, y in zip(pieces, pieces[1:-1], strict=False):
                    ends.append((x[x.rfind(" ") + 1 :], y.lstrip()[:1] or "."))
                x = pieces[-2]
                ends.append((x[x.rfind(" ") + 1 :], pieces[-1].lstrip()[:1] or " "))
        self.ends.update(ends)

    def rows(self) -> dict[str, list[int]]:
        """See :func:`tally`."""
        out: dict[str, list[int]] = defaultdict(lambda: [0] * 6)
        last = {}
        for run, k in self.firsts.items():
            m = _TOKENS.match(run)
            token = m.group().lstrip(_OPENERS) if m else ""
            if token[:1].isupper():
                out[token.lower()][5] += k
        for run, k in self.runs.items():
            for m in _POINT_OR_NOT.finditer(run):
                raw, j = m.group(), m.end()
                pointed = raw[-1] == "."
                token = raw[: len(raw) - pointed].lstrip(_OPENERS)
                row = out[token.lower()]
                if token[:1].isupper():
                    row[4] += k
                if not pointed:
                    row[0] += k
                elif j == len(run):
                    last[run[:-1]] = row
                elif run[j] in ",;:)":
                    row[1] += k
                    row[2] += k * (run[j] != ")")
        for (run, following), k in self.ends.items():
            if run in last:
                row = last[run]
                row[1] += k
                row[2] += k * (following.islower() or following in ",;:")
                row[3] += k * (following == " ")
        return out


def tally(paragraphs: Iterable[str]) -> dict[str, list[int]]:
    """Of each word in paragraphs whose white space is blanks: how often it occurs without a point; with a point, with a point and something that can't start a sentence, with
    a point at the end of a paragraph; capitalised, capitalised at the start of a paragraph."""
    counts = _Tally()
    counts.add(list(paragraphs))
    return counts.rows()


def classes(counts: Iterable[tuple[str, int, int, int, int, int, int]]) -> tuple[dict[str, str], dict[str, str]]:
    """How words behave, by their tallies, for words that occur three times or more.

    Before a point: whether the word also occurs without one, how often something follows the point that can't start a sentence, and whether it ever ends a
    paragraph. After a place: how often the word, capitalised, starts paragraphs.
    """
    before, after = {}, {}
    for name, plain, pointed, low, last, upper, starts in counts:
        if pointed and pointed + plain >= 3:
            share = low / pointed
            before[name] = ("always " if not plain else "often " if plain <= pointed else "seldom ") + ("none" if not share else "some" if share < 0.3 else "most") + (" last" if last else "")
        if upper >= 3:
            after[name] = "starts" if starts > 0.2 * upper else "some" if starts else "never"
    return before, after


def behaviour(texts: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """How words behave in texts (paragraphs without outer white space): see :func:`classes`."""
    return classes((name, *row) for name, row in tally(texts).items())


def _size(token: str) -> str:
    return str(min(len(token), 6)) + ("." if "." in token else "")


def features(model: Model, key: Key) -> list[str]:
    """The names of a place's features."""
    mark, kind, token, shape, word, blank, extra = key
    gap = "_" if blank else "|"
    if mark == "blank":
        return ["b", "b " + kind, "b>" + shape, f"b {kind}>{shape}", "b<" + token, "b<" + token[-1:], "b>>" + word, "b>>" + word[:1]]
    if mark != ".":
        return [mark, f"{mark}{gap}{shape}", f"{mark}{gap}{shape} {extra}", f"{mark} {extra}", f"{mark} {token}", mark + gap] + ([f"{mark}{gap}{word}"] if shape == "punct" else [])
    name = word.lower()
    how, starter = model.before.get(token, "new"), model.after.get(name, "new") if shape == "upper" else ""
    kind = f"{kind} {extra}" if extra else kind
    out = [".", f".{gap}{shape}", f".{kind}", f".{kind}{gap}{shape}", f".{how}", f".{how}{gap}{shape}", f".#{_size(token)}", f".#{_size(token)}{gap}{shape}", f".s {starter}", f".s {how} {starter}", f".p {token}", f".p {token}{gap}{shape}", f".n {name}"]
    return out + ([f".{gap}{word}"] if shape == "punct" else [])


def settled(model: Model, key: Key) -> int | None:
    """The tag of a place (1 boundary, 0 inside) where the definition of a sentence settles it; None where it is left open. Only used on examples."""
    mark, kind, token, shape, word, blank, extra = key
    capital = shape in ("upper", "mixed", "letter")
    if mark == "inner":
        return 0
    if mark == "blank":
        return None if kind == "own" and shape == "own" else 0
    if shape == "none":
        return 1
    if mark == "close":
        return 0 if extra == "on" or shape == "lower" or shape == "punct" and word in ",;:-–—" else 1
    if mark == "ellipsis":
        return 0 if extra == "cjk" else 1 if shape == "upper" else None if shape == "mixed" else 0
    if mark == "strong":
        return 0 if not blank and (shape in ("lower", "digit") or shape == "punct" and word in ",;:=&/") and extra != "full" else 1
    if mark == "greek":
        return int(blank)
    if kind in ("glued", "never", "initial") or shape == "punct" and word in ",;:" or kind == "integer" and extra:
        return 0
    how = model.before.get(token, "")
    if not blank:
        return None if kind == "maybe" else int(capital and kind in ("word", "number", "integer"))
    if kind == "maybe":
        return int(capital)
    if kind == "integer":
        return 1 if capital else None
    if kind == "word" and how.startswith("always") and not how.endswith("last"):
        return None
    if shape == "lower":
        return None if how.split(" ")[1:2] == ["most"] else 1
    return 1


def _spot(end: int, last: int) -> int:
    gap = end - last
    return _CLOSE_BY if gap < 6 else _NEAR if gap < 14 else _FAR


#: Transitions, and the scores below and above which a place is surely inside or a boundary by them.
_sure: tuple[list | None, float, float] = None, 0.0, 0.0


def _bounds(transitions: list) -> tuple[float, float]:
    """(low, high): scores below are of places inside, and scores above of boundaries, whatever the tags of the places around."""
    (ii, ib), (bi, bb) = ([x[:_OUTSIDE] for x in row] for row in transitions)
    to = [b - a for one, two in ((ii, ib), (bi, bb)) for a, b in zip(one, two, strict=True)]
    on = [0.0, *(b - a for one, two in ((ii, bi), (ib, bb)) for a, b in zip(one, two, strict=True))]
    # a little apart, so that rounding does not matter
    return -max(to) - max(on) - 1e-6, -min(to) - min(on) + 1e-6


def decode(found: list[tuple[int, float]], transitions: list) -> list[int]:
    """Viterbi over the places (end, score of a boundary): the ends of the best sequence of tags. Before the first place is a boundary at 0."""
    global _sure
    if _sure[0] is not transitions:
        _sure = transitions, *_bounds(transitions)
    _, low, high = _sure
    ends = [e for e, score in found if score > high]
    if len(ends) + len([1 for _, score in found if score < low]) == len(found):
        return ends  # no sequence of tags is better at any place
    (ii, ib), (bi, bb) = transitions
    inside, boundary, back, last = -1e30, 0.0, [], 0
    for end, score in found:
        gap = end - last
        spot = _CLOSE_BY if gap < 6 else _NEAR if gap < 14 else _FAR
        last = end
        a, b = inside + ii[spot], boundary + bi[spot]
        c, d = inside + ib[spot], boundary + bb[spot]
        back.append((b > a, d > c))
        inside, boundary = (b if b > a else a), (d if d > c else c) + score
    state, ends = boundary > inside, []
    for (end, _), step in zip(reversed(found), reversed(back), strict=True):
        if state:
            ends.append(end)
        state = step[state]
    return ends[::-1]


def split(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a text, without outer white space. None for null, empty and blank texts."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    flat, scores, transitions, known = _flat(text), model.scores, model.transitions, model.known

    for start, end, is_list in units(text):
        ends = [] if is_list else decode([(e, scores[key]) for e, key in places(flat[start:end].rstrip(" "), known)], transitions)
        a = start
        for b in (*(start + e for e in ends), end):
            last = b
            while a < last and flat[a] == " ":
                a += 1
            while last > a and flat[last - 1] == " ":
                last -= 1
            if a < last:
                out.append((a, last))
            a = b
    return out


# --- training -----------------------------------------------------------------------------------------------------


def _joined(parts: list[str]) -> tuple[str, set[int]]:
    """Paragraphs with the breaks between them taken out, and where those were. Without blanks only between characters of scripts that have none."""
    text, ends = "", set()
    for p in parts:
        if text:
            ends.add(len(text))
            text += "" if _CJK.match(p[0]) and (_CJK.match(text[-1]) or text[-1] in "。！？") else " "
        text += p
    return text, ends


def _balanced(p: str) -> bool:
    return not _QUOTES.search(p) or p.count('"') % 2 == 0 and p.count("“") + p.count("„") * (p.count("”") > 0) <= p.count("”") + p.count("“") * (p.count("„") > 0) and p.count("«") == p.count("»") and p.count("「") == p.count("」")


def _paragraphs(text: str) -> list[str]:
    flat = _flat(text)
    parts = (flat[a:b].strip(" ") for a, b, is_list in units(text) if not is_list)
    return [p for p in parts if p]


def examples(model: Model, texts: list[str | None]) -> list[list[tuple[int, Key, int | None]]]:
    """Chains of (end, description, tag or None): the seeds, wholly labelled, and joined paragraphs of texts."""
    chains = []
    for sentences in SEEDS:
        for every in (1, 2, 3):
            # each sentence alone, and in twos and threes
            for i in range(0, len(sentences) - every + 1):
                text, ends = _joined(sentences[i : i + every])
                chains.append([(e, key, int(e in ends or e == len(text))) for e, key in places(text, model.known)])
    return [c for c in chains if c] + [c for text in texts for c in of_text(model, text)]


def of_text(model: Model, text: str | None) -> list[list[tuple[int, Key, int | None]]]:
    """The chains of the joined paragraphs of a text."""
    chains, labels, parts = [], model.labels, [p for p in _paragraphs(text or "") if _balanced(p)]
    if any(_HAS_THAI.match(p[-1]) for p in parts):
        parts = [q for q in (" ".join(_PUNCTUATION.sub("", p).split()) for p in parts) if q]
    for i in range(0, len(parts), 6):
        whole, ends = _joined(parts[i : i + 6])
        numbers = {x + m.end() - 1 for x in (0, *(e + 1 for e in ends)) if (m := _NUMBERED.match(whole, x))}  # a number that starts a paragraph
        chains.append([(e, key, 1 if e in ends else 0 if e in numbers else labels[key]) for e, key in places(whole, model.known)])
    return [c for c in chains if c]


class _Chains:
    """Stretches of chains as arrays: place numbers (0: none), distances, and what the labels allow."""

    def __init__(self, chains: list[list[tuple[int, Key, int | None]]]) -> None:
        numbers: dict[Key, int] = {}
        chains = [c for c in chains if c]
        row = np.array([numbers.setdefault(key, len(numbers) + 1) for chain in chains for _, key, _ in chain], np.int32)
        tag = np.array([2 if label is None else label for chain in chains for _, _, label in chain], np.int8)
        end = np.array([e for chain in chains for e, _, _ in chain], np.int64)
        self.keys = list(numbers)
        sizes = np.array([len(c) for c in chains], np.int64)
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(row)) - np.repeat(first, sizes)
        gap = end - np.where(place > 0, np.roll(end, 1), 0)
        spot = np.where(gap < 6, _CLOSE_BY, np.where(gap < 14, _NEAR, _FAR))
        # the longest stretches come first
        at = place % STRETCH
        stretch = np.cumsum(at == 0) - 1
        lengths = np.bincount(stretch) if len(row) else np.zeros(0, np.int64)
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.row, self.spot, self.tag = (np.full((STRETCH, len(order)), x, kind) for x, kind in ((0, np.int32), (_OUTSIDE, np.int8), (2, np.int8)))
        for whole, own in ((self.row, row), (self.spot, spot), (self.tag, tag)):
            whole[at, rank[stretch]] = own
        #: Stretches that go on at each step.
        self.there = (self.spot != _OUTSIDE).sum(axis=1)

    @property
    def barred(self) -> np.ndarray:
        """What labels do not allow, as scores."""
        out = np.zeros((*self.row.shape, 2))
        out[..., 1][self.tag == 0] = -1e6
        out[..., 0][self.tag == 1] = -1e6
        return out

    def marginals(self, scores: np.ndarray, transitions: np.ndarray, barred: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """How probable a boundary is at each place, and the expected transitions, by forward and backward sums."""
        steps, n = self.row.shape
        own = np.zeros((steps, n, 2))
        own[..., 1] = scores[self.row]
        if barred is not None:
            own += barred
        moves = transitions.transpose(2, 0, 1)[self.spot]
        alpha, beta = np.full((steps, n, 2), 0.0), np.zeros((steps, n, 2))
        total = np.zeros(n)
        for t in range(steps):
            m = self.there[t]
            if not m:
                break
            if t:
                x = alpha[t - 1, :m, :, None] + moves[t, :m]
                alpha[t, :m] = np.logaddexp(x[:, 0], x[:, 1]) + own[t, :m]
            else:
                alpha[0, :m] = moves[0, :m, 1] + own[0, :m]
            total[:m] = np.logaddexp(alpha[t, :m, 0], alpha[t, :m, 1])
        for t in range(steps - 2, -1, -1):
            m = self.there[t + 1]
            if m:
                x = moves[t + 1, :m] + (own[t + 1, :m] + beta[t + 1, :m])[:, None, :]
                beta[t, :m] = np.logaddexp(x[..., 0], x[..., 1])
        there = self.spot != _OUTSIDE
        boundary = np.where(there, np.exp(np.minimum(0.0, alpha[..., 1] + beta[..., 1] - total)), 0.0)
        expected = np.zeros((2, 2, 4))
        pair = np.exp(np.minimum(0.0, alpha[:-1, :, :, None] + moves[1:] + (own[1:] + beta[1:])[:, :, None, :] - total[:, None, None]))
        pair[~there[1:]] = 0.0
        for spot in range(_OUTSIDE):
            expected[:, :, spot] = pair[self.spot[1:] == spot].sum(axis=0)
            first = (self.spot[0] == spot) & there[0]
            expected[1, 1, spot] += boundary[0, first].sum()
            expected[1, 0, spot] += (1 - boundary[0, first]).sum()
        return boundary, expected


def _stepped(spot: np.ndarray, *others: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Blocks of stretches without the ends that they lack, one step after another: [stretches at each step, distances, others...]."""
    for i in range(0, spot.shape[1], WIDE):
        part = slice(i, i + WIDE)
        inside = spot[:, part] != _OUTSIDE
        there = inside.sum(axis=1)
        yield [there[there > 0], *(x[:, part][inside] for x in (spot, *others))]


def _ratios(transitions: np.ndarray) -> np.ndarray:
    """Of the moves inside to boundary, boundary to inside and boundary to boundary, at each distance: relative to staying inside."""
    moves = np.exp(transitions)
    return np.stack([moves[0, 1], moves[1, 0], moves[1, 1]]) / moves[0, 0]


def _passed(enter: np.ndarray, leave: np.ndarray, stay: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How probable a boundary is at each place of a block, at it and at the place before, and at the place before. Given are the ratios to staying inside, those of the boundary's
    own with those of the moves to it."""
    starts = np.cumsum(there) - there
    # (places of a step, the places before them)
    steps = [(slice(a, a + m), slice(b, b + m)) for b, a, m in zip(starts, starts[1:], there[1:], strict=False)]
    first = slice(0, there[0])
    ahead, later, both, before = np.empty(len(enter)), np.ones(len(enter)), np.empty(len(enter)), np.ones(len(enter))
    left = np.empty(len(enter))
    ahead[first] = stay[first] / leave[first]
    for now, last in steps:
        x = ahead[last]
        y = np.multiply(x, leave[now], out=left[now])
        z = np.multiply(x, stay[now], out=ahead[now])
        z += enter[now]
        z /= y + 1
    for now, last in reversed(steps):
        y, z = later[now], later[last]
        on = np.multiply(stay[now], y, out=both[now])
        np.add(leave[now], on, out=z)
        y = enter[now] * y
        y += 1
        z /= y
        on *= ahead[last]
        y += left[now]
        y += on
        on /= y
    boundary = ahead * later
    boundary /= 1 + boundary
    # the tag before the first place is a boundary
    both[first] = boundary[first]
    for now, last in steps:
        before[now] = boundary[last]
    return boundary, both, before


def _moves(every: np.ndarray | float, one: np.ndarray, two: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Expected transitions from the sums at each distance: of places, of boundaries at them, at them and before them, and before them."""
    expected = np.zeros((2, 2, 4))
    expected[1, 1], expected[0, 1], expected[1, 0], expected[0, 0] = two, one - two, old - two, every - one - old + two
    return expected


def _sums(own: np.ndarray, there: np.ndarray, spot: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :meth:`_Chains.marginals`, from the ratio of boundary to inside at each place of a block: 0 and very large ones are labels."""
    spot = spot.astype(np.intp)
    ib, bi, bb = (x[spot] for x in _ratios(transitions))
    boundary, both, before = _passed(own * ib, bi, own * bb, there)
    every, two, one, old = (np.bincount(spot, x, minlength=4) for x in (None, both, boundary, before))
    return boundary, _moves(every, one, two, old)


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in two bytes each, if they fit."""
    return x.astype(np.uint16 if x.max(initial=0) < 2**16 else np.int32)


class _Part:
    """Stretches as blocks, the numbers of their places' features, and what follows from wholly labelled stretches alone: all that a pass needs. A place is its description's
    number and distance in one (three times the one, plus the other)."""

    def __init__(self, data: _Chains, lists: list[list[int]]) -> None:
        self.n_keys = len(lists)
        self.sizes, self.name_of = np.array([len(x) for x in lists], np.int32), np.array([f for x in lists for f in x], np.int32)
        left = ((data.tag == 2) & (data.spot != _OUTSIDE)).any(axis=0)
        places = data.row * _OUTSIDE + data.spot
        self.blocks = [(there, _small(x)) for there, _, x in _stepped(data.spot, places)]
        self.open = [(there, _small(x), tag) for there, _, x, tag in _stepped(data.spot[:, left], places[:, left], data.tag[:, left])]
        tag, spot = data.tag[:, ~left], data.spot[:, ~left]
        here = spot != _OUTSIDE
        self.labelled = np.bincount(data.row[:, ~left][here], tag[here], minlength=self.n_keys + 1).astype(float)
        before = np.concatenate([np.ones((1, tag.shape[1]), np.int8), tag[:-1]])
        self.moves = np.bincount((before[here] * 8 + tag[here] * 4 + spot[here]).astype(np.int64), minlength=16).reshape(2, 2, 4).astype(float)
        self.moves[0, 0] -= np.bincount(spot[here], minlength=4)

    @property
    def key_of(self) -> np.ndarray:
        return np.repeat(np.arange(1, self.n_keys + 1), self.sizes)

    def number(self, names: list[str], numbers: dict[str, int]) -> _Part:
        """The part itself, with the numbers that its features have among all; features that have none are left out, and descriptions of equal features become one."""
        new, key_of = np.array([numbers.get(f, -1) for f in names], np.int32)[self.name_of], self.key_of[:]
        new, key_of = new[new >= 0], key_of[new >= 0]
        ends = np.cumsum(np.bincount(key_of, minlength=self.n_keys + 1))
        distinct: dict[bytes, int] = {}
        same = np.array([0, *(distinct.setdefault(new[a:b].tobytes(), len(distinct) + 1) for a, b in zip(ends, ends[1:], strict=False))], np.int32)
        lists = [np.frombuffer(x, np.int32) for x in distinct]
        self.n_keys, self.sizes, self.name_of = len(lists), _small(np.array([len(x) for x in lists], np.int32)), _small(np.concatenate([np.zeros(0, np.int32), *lists]))
        self.labelled = np.bincount(same, self.labelled, minlength=self.n_keys + 1)
        self.blocks = [(there, _small(same[x // _OUTSIDE] * _OUTSIDE + x % _OUTSIDE)) for there, x in self.blocks]
        self.open = [(there, _small(same[x // _OUTSIDE] * _OUTSIDE + x % _OUTSIDE), tag) for there, x, tag in self.open]
        return self

    def slope(self, weights: np.ndarray, transitions: np.ndarray) -> np.ndarray:
        """How the likelihood of the labels grows with each weight, and with each transition."""
        # the places of wholly labelled stretches are in ``moves`` already, those of others cancel out
        key_of, size = self.key_of, (self.n_keys + 1) * _OUTSIDE
        scores = np.bincount(key_of, weights[self.name_of], minlength=self.n_keys + 1)
        own, (ib, bi, bb) = np.exp(np.clip(scores, -200, 200))[:, None], _ratios(transitions)[:, :_OUTSIDE]
        enter, leave, stay = (own * ib).ravel(), np.tile(bi, self.n_keys + 1), (own * bb).ravel()
        # sums at each description and distance
        one, two, old = (np.zeros(size) for _ in range(3))
        for there, x in self.blocks:
            x = x.astype(np.intp)
            boundary, both, before = _passed(enter[x], leave[x], stay[x], there)
            for total, values in ((one, boundary), (two, both), (old, before)):
                total -= np.bincount(x, values, minlength=size)
        ib, bi, bb = (np.append(a, 0.0) for a in (ib, bi, bb))
        for there, x, tag in self.open:
            x = x.astype(np.intp)
            spot = x % _OUTSIDE
            set_to = np.where(tag == 1, 1e60, 0.0)
            boundary, both, before = _passed(np.where(tag == 2, enter[x], set_to * ib[spot]), bi[spot], np.where(tag == 2, stay[x], set_to * bb[spot]), there)
            for total, values in ((one, boundary), (two, both), (old, before)):
                total += np.bincount(x, values, minlength=size)
        per_key = self.labelled + sum(one[spot::_OUTSIDE] for spot in range(_OUTSIDE))
        moves = self.moves + _moves(0.0, *(np.array([*(x[spot::_OUTSIDE].sum() for spot in range(_OUTSIDE)), 0.0]) for x in (one, two, old)))
        return np.concatenate([np.bincount(self.name_of, per_key[key_of], minlength=len(weights)), moves.ravel()])


def _named(model: Model, chains: list[list[tuple[int, Key, int | None]]]) -> tuple[_Part, list[str], np.ndarray]:
    """Chains as a part, with its features and the times of each."""
    data = _Chains(chains)
    names: dict[str, int] = {}
    part = _Part(data, [[names.setdefault(f, len(names)) for f in features(model, key)] for key in data.keys])
    times = np.bincount(data.row.ravel(), minlength=part.n_keys + 1)
    return part, list(names), np.bincount(part.name_of, np.repeat(times[1:], part.sizes), minlength=len(names)).astype(np.int64)


def _climbed(model: Model, names: list[str], slope_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Model:
    """The model with the weights of features and transitions that are learned in ``PASSES`` passes."""
    weights, moves = np.zeros(len(names)), np.zeros((2, 2, 4))
    # steps of the size of a running mean over a running deviation
    now = np.concatenate([weights, moves.ravel()])
    mean, square = np.zeros_like(now), np.zeros_like(now)
    for i in range(1, PASSES + 1):
        slope = slope_of(weights, moves) - RIDGE * now
        mean, square = 0.8 * mean + 0.2 * slope, 0.95 * square + 0.05 * slope * slope
        now = now + 0.3 * (1 - i / (PASSES + 5)) * (mean / (1 - 0.8**i)) / (np.sqrt(square / (1 - 0.95**i)) + 1e-6)
        weights, moves = now[: len(names)], now[len(names) :].reshape(2, 2, 4)
    model.weights = {f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 1e-3}
    model.transitions = moves.tolist()
    return model


def train(texts: list[str | None]) -> Model:
    """The model of a list of texts, in any case of the seeds. Equal inputs give equal models.

    Maximises the likelihood of what is labelled, all tags that are left open summed over, less ``RIDGE`` times the squared weights.
    """
    own = [p for text in texts for p in _paragraphs(text or "")]
    before, after = behaviour(own + [s for sentences in SEEDS for s in sentences])
    model = Model(before=before, after=after)
    part, found, times = _named(model, examples(model, texts))
    names = sorted(f for f, n in zip(found, times, strict=True) if n >= 3)
    return _climbed(model, names, part.number(found, {f: i for i, f in enumerate(names)}).slope)


_COUNTS = ("plain", "pointed", "low", "last", "upper", "starts")
_TALLY = pa.schema([("name", pa.string()), *((c, pa.int64()) for c in _COUNTS)])
_TALLY_SQL = "name string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
_NAMED_SQL = "part binary, names array<string>, times array<bigint>"


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without searches for cycles of garbage, of which there are none among very many small objects."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


_spared: list[bool] = []


def _spare_modules() -> None:
    """Spark's workers search for cycles of garbage after each task; what was imported by then is left out from now on, which takes less time than a pass has otherwise."""
    if not _spared:
        _spared.append(True)
        gc.collect()
        gc.freeze()


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) to the tallies of words, added up over many texts."""
    counts = _Tally()

    def rows() -> pa.RecordBatch:
        found = counts.rows()
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(c) for c in np.array(list(found.values()), np.int64).reshape(-1, len(_COUNTS)).T.copy())], schema=_TALLY)

    with _uncollected():
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                counts.add([p for text in batch.column(0).slice(i, 500).to_pylist() for p in _paragraphs(text)])
                if len(counts.runs) + len(counts.ends) > 400_000:
                    yield rows()
                    counts = _Tally()
        if counts.runs:
            yield rows()


def _named_parts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(text) to parts of about ``PART`` places, their features and the times of each."""
    chains, n = [], 0

    def row() -> pa.RecordBatch:
        part, names, times = _named(model, chains)
        chains.clear()
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary()), pa.array([names], pa.list_(pa.string())), pa.array([times], pa.list_(pa.int64()))], names=["part", "names", "times"])

    with _uncollected():
        for batch in batches:
            for i in range(0, batch.num_rows, 50):
                for text in batch.column(0).slice(i, 50).to_pylist():
                    new = of_text(model, text)
                    chains += new
                    n += sum(map(len, new))
                    if n >= PART:
                        yield row()
                        n = 0
        if chains:
            yield row()


def fitted(spark: SparkSession, documents: DataFrame) -> Model:
    """The model of all documents, in any case of the seeds: as :func:`train`, but nothing of the size of the documents is held in one place.

    Words are counted, examples made and kept in the shared folder, and each pass adds up the slopes of all parts. What is collected and sent along grows with the words that
    occur three times or more next to places. Sums depend on how rows are partitioned in their last digits.
    """
    texts = documents.where("text is not null and text <> ''").select("text")
    seeds = [(name, *row) for name, row in tally(s for sentences in SEEDS for s in sentences).items()]
    words = texts.mapInArrow(_tallies, _TALLY_SQL).unionByName(spark.createDataFrame(seeds, _TALLY_SQL).coalesce(1)).groupBy("name").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    before, after = classes(tuple(r) for r in words.where("pointed > 0 and pointed + plain >= 3 or upper >= 3").select("name", *_COUNTS).collect())
    model = Model(before=before, after=after)
    sent = spark.sparkContext.broadcast((before, after))
    part, names, times = _named(model, examples(model, []))
    own = spark.createDataFrame([(pickle.dumps(part), names, times.tolist())], _NAMED_SQL).coalesce(1)
    parts = cut(texts.mapInArrow(lambda it: _named_parts(it, Model(before=sent.value[0], after=sent.value[1])), _NAMED_SQL).unionByName(own))
    seen = parts.select(F.explode(F.arrays_zip("names", "times")).alias("x")).groupBy("x.names").agg(F.sum("x.times").alias("n")).where("n >= 3")
    names = sorted(r["names"] for r in seen.select("names").collect())
    numbers = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(pickle.loads(part.as_py()).number(found.as_py(), numbers.value))], pa.binary())], names=["part"])

    rows = cut(parts.select("part", "names").mapInArrow(number, "part binary"))
    # passes are short, so that many small tasks would take longer to start than to run
    rows = rows.coalesce(max(1, -(-rows.count() // PARTS_EACH)))
    tasks = rows.rdd.getNumPartitions()
    return _climbed(model, names, lambda weights, moves: _slope(rows, tasks, weights, moves))


def _added(key: tuple, table: pa.Table) -> pa.Table:
    rows = sorted(zip(table["task"].to_pylist(), table["slope"].to_pylist(), strict=True))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([0], pa.int32()), "slope": pa.array([sum(np.frombuffer(x) for _, x in rows).tobytes()], pa.binary())})


def _slope(parts: DataFrame, tasks: int, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The sum of the slopes of all parts, which are in so many partitions. Slopes of very many values are added up in slices by the executors."""
    size = len(weights) + moves.size

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _spare_modules()
        total = np.zeros(size)
        for batch in batches:
            for part in batch.column(0):
                total += pickle.loads(part.as_py()).slope(weights, moves)
        n, task = -(-size // SLICE), TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([task] * n, pa.int32()), pa.array([total[i * SLICE : (i + 1) * SLICE].tobytes() for i in range(n)], pa.binary())], names=["slice", "task", "slope"])

    schema = "slice int, task int, slope binary"
    slopes = parts.mapInArrow(one, schema)
    if tasks * size > DIRECT:
        slopes = slopes.groupBy("slice").applyInArrow(_added, schema)
    total = np.zeros(size)
    for r in sorted(slopes.collect()):
        x = np.frombuffer(r["slope"])
        total[r["slice"] * SLICE : r["slice"] * SLICE + len(x)] += x
    return total


_SQL = "doc_id bigint, sent_start int, sent_end int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("sent_start", pa.int32()), ("sent_end", pa.int32())])


def sample(documents: DataFrame, size: int = SAMPLE, chars: int = SAMPLE_CHARS) -> list[str]:
    """Texts for a model of a part of the documents: those of the ``size`` smallest hashes of ids, ``chars`` characters of each. Doesn't depend on how rows are partitioned."""
    drawn = documents.where(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("u", uniform("doc_id", seed=5))
    share = min(1.0, 1.5 * size / max(1, documents.count()))
    near = drawn.where(F.col("u") < share)
    top = near.select("u").orderBy("u").limit(size).collect()  # numbers alone
    if not top:
        return []
    rows = near.where(F.col("u") <= top[-1]["u"]).select("u", F.substring("text", 1, chars).alias("text")).limit(2 * size).collect()
    return [r["text"] for r in sorted(rows)]


def sentences(spark: SparkSession, documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, sent_start, sent_end) of every sentence of every document, in code points; ends are exclusive.

    ``documents`` has (doc_id, text). Without a ``model``, one is ``fitted`` to all documents; it is sent along. Null, empty and blank texts have no sentences. Repeated documents repeat theirs.
    """
    if model is None:
        model = fitted(spark, documents)
    own = spark.sparkContext.broadcast((model.weights, model.transitions, model.before, model.after))

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model(*own.value)
        with _uncollected():
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    part = batch.slice(i, 500)
                    ids, starts, ends = [], [], []
                    for k, text in enumerate(part.column(1).to_pylist()):
                        found = split(text, mine)
                        ids += [k] * len(found)
                        starts += [a for a, _ in found]
                        ends += [b for _, b in found]
                    if ids:
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.array(ids, np.int64))), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=_ARROW)

    return documents.select("doc_id", "text").mapInArrow(divided, _SQL)


def distinct_sentences(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """As :func:`sentences`, each row once. Those of a document differ, so that only documents whose id is repeated are compared, unless there are very many of them."""
    model = fitted(spark, documents)
    repeated = cut(documents.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("repeated_id")))
    n = repeated.count()
    if n > BROADCAST_ROWS:
        return sentences(spark, documents, model).distinct()
    if not n:
        return sentences(spark, documents, model)
    same = F.col("doc_id").eqNullSafe(F.col("repeated_id"))
    once, more = (documents.join(F.broadcast(repeated), same, how) for how in ("left_anti", "left_semi"))
    return sentences(spark, once, model).unionByName(sentences(spark, more, model).distinct())
