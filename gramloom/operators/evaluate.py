"""Measures of scored documents (y, score), and tuning of the threshold.

Sweeps over scores need running sums in score order. They first reduce documents to one row per distinct score, then
add up within ranges of scores and over ranges, so that no task holds all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramloom.tables import cut


def confusion(scored: DataFrame) -> DataFrame:
    """One row: ``tp``, ``fp``, ``fn``, ``tn``; positive means a score above 0, and a label above 0."""
    pos, hit = F.col("y") > 0, F.col("score") > 0
    return scored.agg(F.count_if(pos & hit).alias("tp"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(~pos & ~hit).alias("tn"))


def _over(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def measures(counts: DataFrame) -> DataFrame:
    """Adds per cent figures to a confusion row: accuracy, error, precision, recall, f1, specificity, sensitivity, fss, balanced_error.

    Undefined ratios are 0, but the balanced error is null if a class is absent.
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    precision, recall, specificity = _over(tp, tp + fp), _over(tp, tp + fn), _over(tn, tn + fp)
    return counts.select(
        "tp", "fp", "fn", "tn",
        (100 * _over(tp + tn, n)).alias("accuracy"),
        (100 * _over(fp + fn, n)).alias("error"),
        (100 * precision).alias("precision"),
        (100 * recall).alias("recall"),
        (100 * _over(2 * precision * recall, precision + recall)).alias("f1"),
        (100 * specificity).alias("specificity"),
        (100 * recall).alias("sensitivity"),
        (100 * _over(2 * specificity * recall, specificity + recall)).alias("fss"),
        (50 * (F.try_divide(fn, tp + fn) + F.try_divide(fp, fp + tn))).alias("balanced_error"),
    )


def _running(per: DataFrame, columns: list[str], descending: bool) -> DataFrame:
    """Adds ``c_<column>``: sums over all rows up to this one in the order of ``score``; rows are split into ranges of scores."""
    keys = F.desc("score") if descending else F.asc("score")
    ranged = per.repartitionByRange(keys).withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged)
    totals = ranged.groupBy("__part").agg(*(F.sum(c).alias(c) for c in columns))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = totals.select("__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias("s_" + c) for c in columns))
    inside = Window.partitionBy("__part").orderBy(keys).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(starts), "__part").withColumns({"c_" + c: F.sum(c).over(inside) + F.col("s_" + c) for c in columns})


def _per_score(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("score").isNotNull()).groupBy("score").agg(F.count_if(F.col("y") > 0).alias("p"), F.count_if(F.col("y") <= 0).alias("n"))


def auc(scored: DataFrame) -> DataFrame:
    """One row: ``auc`` in per cent, by trapezoids over tie groups; 0 if a class is absent."""
    run = _running(_per_score(scored), ["p", "n"], True)
    area = F.sum(F.col("n") * (F.col("c_p") - F.col("p") / 2.0))
    return run.agg((100 * _over(area, F.sum("p").cast("double") * F.sum("n"))).alias("auc"))


def auc50(scored: DataFrame, most: int = 50) -> DataFrame:
    """One row: ``auc50``, the area up to the first ``most`` negatives, in per cent.

    As defined for this measure, the last trapezoid, from the tie group that reaches ``most`` negatives on, ends at all positives, and the
    area is divided by ``most`` even if there are fewer negatives. 0 if a class is absent.
    """
    run = _running(_per_score(scored), ["p", "n"], True)
    capped = F.least("c_n", F.lit(most)), F.least(F.col("c_n") - F.col("n"), F.lit(most))
    all_p = run.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    rows = run.crossJoin(F.broadcast(all_p)).where(capped[1] < most)
    reached = (F.col("c_n") >= most) & (F.col("all_n") > most)
    top = F.when(reached, F.col("all_p")).otherwise(F.col("c_p"))
    area = (capped[0] - capped[1]) * ((F.col("c_p") - F.col("p")) + top) / 2.0
    return rows.agg((100 * _over(F.sum(area), F.max("all_p") * F.lit(float(most)))).alias("auc50"))


def sweep(scored: DataFrame) -> DataFrame:
    """(threshold, errors) at every boundary: below all scores, midway between neighbours, above all."""
    run = _running(_per_score(scored), ["p", "n"], False)
    # the next higher score, across ranges: the lowest of each later range
    firsts = run.groupBy("__part").agg(F.min("score").alias("low"))
    after = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("__part", F.min("low").over(after).alias("beyond"))
    inside = Window.partitionBy("__part").orderBy("score")
    rows = run.join(F.broadcast(firsts), "__part").withColumn("higher", F.coalesce(F.lead("score").over(inside), F.col("beyond")))
    whole = run.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.max("score").alias("top"))
    # with a threshold above a score, positives up to it are missed and negatives beyond it are false alarms
    mid = rows.crossJoin(F.broadcast(whole)).where("higher is not null").select(((F.col("score") + F.col("higher")) / 2).alias("threshold"), (F.col("c_p") + F.col("all_n") - F.col("c_n")).alias("errors"))
    low = whole.where("all_p is not null").select(F.lit(-1.7976931348623157e308).alias("threshold"), F.col("all_n").alias("errors"))
    high = whole.where("all_p is not null").select((F.col("top") + 1).alias("threshold"), F.col("all_p").alias("errors"))
    return low.unionByName(mid).unionByName(high)


def tuned(scored: DataFrame) -> DataFrame:
    """The one (threshold, errors) of fewest errors; of equals, the lowest threshold."""
    return sweep(scored).orderBy("errors", "threshold").limit(1)


def tune_report(scored: DataFrame) -> DataFrame:
    """One row: auc, 1 - auc, fewest errors, accuracy and best threshold."""
    n = scored.where("score is not null").agg(F.count("*").alias("n_docs"))
    return tuned(scored).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(auc(scored))).select("auc", (100 - F.col("auc")).alias("auc_error"), F.col("errors").alias("min_errors"), (100 * (1 - F.col("errors") / F.col("n_docs"))).alias("accuracy"), F.col("threshold").alias("best_threshold"))


def report(scored: DataFrame) -> DataFrame:
    """One row with all measures, auc, auc50 and the number of documents without a match (``n_matched`` = 0)."""
    oov = scored.agg(F.count_if(F.col("n_matched") == 0).alias("oov_docs"))
    return measures(confusion(scored)).crossJoin(F.broadcast(auc(scored))).crossJoin(F.broadcast(auc50(scored))).crossJoin(F.broadcast(oov))
