"""Applying a model: matching its patterns in documents, scores, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.functions.losses import probability
from gramloom.operators.patterns import WILDCARD, masked, windows

#: Different placings of wildcards that a model may have.
SHAPES = 2_000


def shapes(model: DataFrame) -> list[tuple[int, ...]]:
    """The lengths and placings of wildcards that occur in a model: all that has to be generated from documents."""
    flags = F.transform("tokens", lambda t: F.when(t == WILDCARD, 1).otherwise(0))
    rows = model.where(F.size("tokens") > 0).select(flags.alias("m")).distinct().limit(SHAPES + 1).collect()
    if len(rows) > SHAPES:
        raise ValueError(f"a model with more than {SHAPES} placings of wildcards")
    return sorted(tuple(r["m"]) for r in rows)


def occurrences(docs: DataFrame, model: DataFrame, keys: tuple[str, ...] = ("doc_id",), by: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature_id, weight, pattern) for each place where a pattern of the model stands.

    ``docs`` has (keys, tokens), ``model`` (by, feature_id, pattern, tokens, weight); with ``by``, documents only meet the model of
    the same ``by`` (a part of ``keys``). Patterns are looked up with an equi-join of generated n-grams; the join's strategy follows the model's size.
    """
    wanted = shapes(model)
    rows: DataFrame | None = None
    for size in sorted({len(m) for m in wanted}):
        forms = [masked(F.col("w"), m) for m in wanted if len(m) == size]
        runs = docs.where(F.size("tokens") >= size).select(*keys, F.explode(windows(F.col("tokens"), size)).alias("w"))
        level = runs.select(*keys, F.explode(F.array(*forms)).alias("tokens"))
        rows = level if rows is None else rows.unionByName(level)
    if rows is None:
        return docs.select(*keys).crossJoin(model.drop("tokens", *by)).limit(0)
    return rows.join(model, [*by, "tokens"]).select(*keys, "feature_id", "pattern", "weight")


def matches(docs: DataFrame, model: DataFrame, keys: tuple[str, ...] = ("doc_id",), by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (keys, feature_id, pattern, weight): presence, however often a pattern stands in a document."""
    return occurrences(docs, model, keys, by).distinct()


def scores(docs: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("doc_id",), threshold: float = 0.0) -> DataFrame:
    """(keys, score, prob, n_matched) of every document; without a match the score is minus the threshold."""
    sums = found.groupBy(*keys).agg(F.sum("weight").alias("s"), F.count("*").alias("n"))
    joined = docs.select(*keys).distinct().join(sums, list(keys), "left")
    score = F.coalesce("s", F.lit(0.0)) - threshold
    return joined.select(*keys, score.alias("score"), probability(score).alias("prob"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matched"))


def unmatched(docs: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys) of the documents that hold no pattern of the model."""
    return docs.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def explained(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), by_weight: bool = False) -> DataFrame:
    """(keys, rules): ``pattern weight`` of the matched patterns, by name or by falling weight."""
    item = F.struct((-F.col("weight")).alias("w"), "pattern", "weight") if by_weight else F.struct("pattern", "weight")
    rules = F.transform(F.array_sort(F.collect_list(item)), lambda r: F.concat_ws(" ", r["pattern"], F.format_string("%.6f", r["weight"])))
    return found.groupBy(*keys).agg(F.array_join(rules, "; ").alias("rules"))


def rules_of(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), by_weight: bool = False) -> DataFrame:
    """(keys, rules): (pattern, weight) of the matched patterns, by name or by falling weight."""
    item = F.struct((-F.col("weight")).alias("w"), "pattern", "weight") if by_weight else F.struct("pattern", "weight")
    rules = F.transform(F.array_sort(F.collect_list(item)), lambda r: F.struct(r["pattern"].alias("pattern"), r["weight"].alias("weight")))
    return found.groupBy(*keys).agg(rules.alias("rules"))


def sparse(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, features): ``id:1.0`` of the matched patterns, ids counted from 1, in order."""
    ids = F.array_sort(F.collect_set(F.col("feature_id") + 1))
    return found.groupBy(*keys).agg(F.array_join(F.transform(ids, lambda i: F.concat(i.cast("string"), F.lit(":1.0"))), " ").alias("features"))


def predicted(scored: DataFrame) -> DataFrame:
    """Adds ``predicted``: 1 where the score is above 0, else -1."""
    return scored.withColumn("predicted", F.when(F.col("score") > 0, 1).otherwise(-1))


def trie(model: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, prefix, depth, feature_id): the prefixes of all patterns as nodes, each once; ``feature_id`` where a node is a pattern. Joins on prefixes take the place of a walk."""
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda n: F.slice("tokens", F.lit(1), n))).alias("prefix")
    nodes = model.where(F.size("tokens") > 0).select(*by, prefixes, "tokens", "feature_id")
    own = F.min(F.when(F.col("prefix") == F.col("tokens"), F.col("feature_id"))).alias("feature_id")
    return nodes.groupBy(*by, "prefix").agg(own).select(*by, "prefix", F.size("prefix").alias("depth"), "feature_id")


def prefixes_of(text_tokens: DataFrame, model: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, pattern): the model's patterns, without wildcards, that the tokens of a document start with."""
    plain = model.where(~F.array_contains("tokens", WILDCARD)).select("tokens", "pattern")
    # one row, so that prefixes are built only of lengths that the model has
    sizes = plain.agg(F.array_sort(F.collect_set(F.size("tokens"))).alias("sizes"))
    lengths = F.filter("sizes", lambda n: (n > 0) & (n <= F.size("tokens")))
    heads = text_tokens.crossJoin(F.broadcast(sizes)).select(*keys, F.explode(F.transform(lengths, lambda n: F.slice("tokens", F.lit(1), n))).alias("tokens"))
    return heads.join(plain, "tokens").select(*keys, "pattern").distinct()
