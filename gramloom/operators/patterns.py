"""Indexes and candidate patterns: n-grams, gapped n-grams, support, levels.

A pattern is an array of tokens in which ``*`` stands for exactly one token of any kind.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.tables import cut, numbered

WILDCARD = "*"
#: Frequent patterns (some 60 bytes each) up to which they are broadcast; beyond, joins with them are shuffled.
SMALL = 300_000


def positions(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, token) of every token; documents without tokens have none."""
    return docs.select("doc_id", F.posexplode("tokens").alias("pos", "token"))


def inverted_index(docs: DataFrame) -> DataFrame:
    """(token, doc_id, n, first_pos): the tokens of each document with their number and first place."""
    return positions(docs).groupBy("token", "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(token, n_tokens, support): each distinct token, its occurrences and documents."""
    return inverted_index(docs).groupBy("token").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("support"))


def masks(size: int, maxgap: int) -> list[tuple[int, ...]]:
    """The ways to put wildcards into patterns of a size: never first or last, at most ``maxgap`` in a row. No wildcards at all comes first."""
    out = []
    for inner in product((0, 1), repeat=max(0, size - 2)):
        runs = "".join(map(str, inner)).split("0")
        if max(map(len, runs), default=0) <= maxgap:
            out.append((0, *inner, 0) if size > 1 else (0,))
    return sorted(set(out))


def windows(tokens: Column, size: int) -> Column:
    """All runs of ``size`` tokens; only for arrays that have so many."""
    return F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.slice(tokens, i, F.lit(size)))


def masked(pattern: Column, mask: tuple[int, ...]) -> Column:
    """A pattern with wildcards where the mask has 1."""
    if not any(mask):
        return pattern
    return F.array(*(F.lit(WILDCARD) if m else F.get(pattern, F.lit(i)) for i, m in enumerate(mask)))


def ngrams(docs: DataFrame, size: int, maxgap: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, pattern) of every window of ``size`` tokens, in each of its masked forms. Shorter documents have none."""
    rows = docs.where(F.size("tokens") >= size).select(*keep, F.explode(windows(F.col("tokens"), size)).alias("w"))
    forms = [masked(F.col("w"), m) for m in masks(size, maxgap)]
    return rows.select(*keep, F.explode(F.array(*forms)).alias("pattern")) if len(forms) > 1 else rows.select(*keep, forms[0].alias("pattern"))


def _part(pattern: Column, size: int, end: bool, gapped: bool) -> Column:
    """What is left of a pattern of ``size`` tokens without its last or first one, wildcards that then stand there dropped."""
    if not gapped:
        return F.slice(pattern, 1 if end else 2, size - 1)
    slots = range(size - 2, -1, -1) if end else range(1, size)
    cut_at = None
    for i in slots:
        kept = F.lit(i + 1)
        here = F.get(pattern, F.lit(i)) != WILDCARD
        cut_at = F.when(here, kept) if cut_at is None else cut_at.when(here, kept)
    if end:
        return F.slice(pattern, F.lit(1), cut_at.otherwise(F.lit(0)))
    return F.slice(pattern, cut_at.otherwise(F.lit(size + 1)), F.lit(size))


def pattern_docs(docs: DataFrame, minpat: int = 1, maxpat: int | None = 3, minsup: int = 1, maxgap: int = 0) -> DataFrame:
    """Distinct (pattern, size, doc_id) of the patterns with support of ``minsup`` or more.

    Levels are grown one token at a time. With ``minsup`` above 1, a window enters a level only if what is left of it without its
    last token, and without its first, is frequent (wildcards that then stand at an end are dropped); as supports only shrink, nothing is
    lost. The pairs and frequent patterns of each level are written to the shared folder, so no level computes the ones below again; frequent
    patterns are counted, and up to ``SMALL`` of them are broadcast to the windows, which are then never shuffled whole. ``minpat``
    keeps short patterns out of the result but not out of growing. Without ``maxpat``, levels grow up to the longest document, or until
    no pattern is frequent.
    """
    levels: list[DataFrame] = []
    if minsup > 1:
        docs = cut(docs.select("doc_id", "tokens"))  # read again for each level
    if maxpat is None:
        maxpat = max(minpat, docs.agg(F.max(F.size("tokens"))).first()[0] or 0)
    barren = 0
    known: DataFrame | None = None
    n_known = 0
    for size in range(1, maxpat + 1):
        rows = ngrams(docs, size, maxgap)
        if known is not None:
            for end in (True, False):
                part = _part(F.col("pattern"), size, end, maxgap > 0)
                rows = rows.withColumn("__part", part).join(F.broadcast(known) if n_known <= SMALL else known, "__part", "left_semi").select("doc_id", "pattern")
        pairs = rows.distinct()
        if minsup > 1:
            pairs = cut(pairs)
            frequent = cut(pairs.groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= minsup).select("pattern"))
            n = frequent.count()
            n_known += n
            pairs = pairs.join(F.broadcast(frequent) if n <= SMALL else frequent, "pattern", "left_semi")
            own = frequent.select(F.col("pattern").alias("__part"))
            # a part of nothing but wildcards says nothing against a pattern
            known = own.unionByName(docs.sparkSession.range(1).select(F.array().cast("array<string>").alias("__part"))) if known is None else known.unionByName(own)
            barren = 0 if n else barren + 1
        if size >= minpat:
            levels.append(pairs.select("pattern", F.lit(size).alias("size"), "doc_id"))
        if barren > maxgap and levels:
            break  # wildcards bridge no more levels than this
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def supports(pairs: DataFrame) -> DataFrame:
    """(pattern, size, support) of distinct (pattern, size, doc_id)."""
    return pairs.groupBy("pattern", "size").agg(F.count("*").alias("support"))


def ranked(frame: DataFrame) -> DataFrame:
    """All patterns with their ``rank``, from 1 on, in a depth-first search (by tokens, prefixes first). Ranges of patterns are numbered apart; no task holds all."""
    return numbered(frame, "pattern")


def first_visited(frame: DataFrame, n: int, breadth: bool = True) -> DataFrame:
    """The first ``n`` patterns that a search visits, with their ``rank`` from 1 on: breadth first (size, then tokens) or depth first (tokens, prefixes first).

    A top-n, so only ``n`` rows are ranked in one task.
    """
    keys = ["size", "pattern"] if breadth else ["pattern"]
    return frame.orderBy(*keys).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("bigint"))
