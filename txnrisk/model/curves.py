"""Ranking curves and their areas, exact at any size.

A curve has one row per distinct score. Cumulative counts come from ``ranked_totals``: collapse to distinct
scores, cut the score axis into balanced buckets, carry bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import safe_ratio
from txnrisk.plans.ranked import ranked_totals
from txnrisk.plans.scalars import with_row


def score_levels(df: DataFrame, score: str = "score", label: str = "is_fraud", splits: Sequence[float] | None = None) -> DataFrame:
    """Per distinct score: pos, neg, tp and fp at ``score >= threshold``, and the class totals."""
    sums = {"pos": F.when(F.col(label) == 1, 1).otherwise(0), "neg": F.when(F.col(label) == 0, 1).otherwise(0)}
    levels = ranked_totals(df, score, sums, descending=True, splits=splits)
    scored = F.col(score).isNotNull()
    totals = df.agg(
        F.count_if(scored & (F.col(label) == 1)).alias("n_pos"), F.count_if(scored & (F.col(label) == 0)).alias("n_neg")
    )
    return with_row(levels, totals).select(
        F.col(score).alias("threshold"), "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "n_pos", "n_neg"
    )


def pr_curve(levels: DataFrame, *more: str) -> DataFrame:
    """(threshold, precision, recall, f1); the terminal point without a threshold is left out."""
    return levels.select(
        "threshold",
        safe_ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        safe_ratio("tp", "n_pos").alias("recall"),
        safe_ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("n_pos")).alias("f1"),
        *more,
    )


def threshold_sweep(curve: DataFrame) -> DataFrame:
    """(threshold, precision, recall, f1) by rising threshold: a range sort, no single task."""
    return curve.select("threshold", "precision", "recall", "f1").orderBy("threshold")


def roc_curve(levels: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr), every distinct score."""
    return levels.select("threshold", safe_ratio("fp", "n_neg").alias("fpr"), safe_ratio("tp", "n_pos").alias("tpr"))


def areas(levels: DataFrame) -> DataFrame:
    """One row: average precision Σ ΔR·P, and ROC-AUC with tied scores counted half."""
    precision = safe_ratio("tp", F.col("tp") + F.col("fp"))
    above = F.col("tp") - F.col("pos") / 2
    sums = levels.agg(
        F.sum(F.col("pos") * precision).alias("_ap"),
        F.sum(F.col("neg") * above).alias("_auc"),
        F.max("n_pos").alias("n_pos"),
        F.max("n_neg").alias("n_neg"),
    )
    return sums.select(
        F.try_divide("_ap", "n_pos").alias("pr_auc"),
        F.try_divide("_auc", F.col("n_pos").cast("double") * F.col("n_neg")).alias("roc_auc"),
    )


def best_threshold(curve: DataFrame, min_recall: float | None = None) -> DataFrame:
    """The curve row with the largest F1, the lowest threshold among equals.

    ``min_recall`` prefers rows reaching it; when none does, all rows compete.
    """
    reaches = F.lit(True) if min_recall is None else F.col("recall") >= min_recall
    return curve.orderBy(reaches.desc(), F.desc("f1"), F.asc("threshold")).limit(1)


def mark_threshold(levels: DataFrame, threshold: float) -> DataFrame:
    """The curve row nearest to a threshold, the lower one among equals, with the base rate."""
    distance = F.abs(F.col("threshold") - threshold)
    nearest = levels.orderBy(distance, F.asc("threshold")).limit(1)
    base_rate = safe_ratio("n_pos", F.col("n_pos") + F.col("n_neg"))
    return pr_curve(nearest.withColumn("base_rate", base_rate), "base_rate")
