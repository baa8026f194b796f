"""Confusion counts, reports and error analysis at a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import equal_width_bin, safe_ratio
from txnrisk.model.curves import areas, score_levels
from txnrisk.plans.scalars import with_row

# Columns shown for misjudged rows, and those whose means are compared.
SAMPLE_COLUMNS = [
    "score",
    "amt",
    "BotLikelihoodScore",
    "IPRiskScore",
    "CheckoutTimeSec",
    "SessionDurationSec",
    "IsNewDevice",
    "IsVPN",
    "RiskSignalCount",
]
COMPARED_COLUMNS = ["score", "amt", "BotLikelihoodScore", "CheckoutTimeSec", "SessionDurationSec", "IPRiskScore", "RiskSignalCount"]


def confusion(df: DataFrame, threshold: float, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """One row: tn, fp, fn, tp, precision, recall, f1 (0 where undefined)."""
    hit = F.col(score) >= threshold
    fraud, legit = F.col(label) == 1, F.col(label) == 0
    counts = df.agg(
        F.count_if(legit & ~hit).alias("tn"),
        F.count_if(legit & hit).alias("fp"),
        F.count_if(fraud & ~hit).alias("fn"),
        F.count_if(fraud & hit).alias("tp"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": safe_ratio(tp, tp + fp),
            "recall": safe_ratio(tp, tp + fn),
            "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def evaluate(df: DataFrame, threshold: float, score: str = "score", label: str = "is_fraud") -> DataFrame:
    """Confusion row with threshold, PR-AUC, ROC-AUC, and the shares of fraud caught and legit blocked."""
    out = with_row(confusion(df, threshold, score, label), areas(score_levels(df, score, label)))
    return out.withColumns(
        {
            "threshold": F.lit(float(threshold)),
            "fraud_caught": safe_ratio("tp", F.col("tp") + F.col("fn")),
            "legit_blocked": safe_ratio("fp", F.col("fp") + F.col("tn")),
        }
    )


REPORT_METRICS = ["threshold", "roc_auc", "pr_auc", "precision", "recall", "f1", "tn", "fp", "fn", "tp", "fraud_caught", "legit_blocked"]


def report(evaluation: DataFrame) -> DataFrame:
    """The evaluation row as (metric, value) rows."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in REPORT_METRICS]
    return evaluation.select(F.inline(F.array(*rows)))


def error_kind(decision: str = "decision", label: str = "is_fraud"):
    """FP: legit and declined. FN: fraud and approved. TP: fraud and declined. Null for the rest."""
    d, y = F.lower(F.col(decision)), F.col(label)
    return (
        F.when((y == 0) & (d == "decline"), "FP").when((y == 1) & (d == "approve"), "FN").when((y == 1) & (d == "decline"), "TP")
    )


def error_slices(df: DataFrame) -> DataFrame:
    """Rows that fall in a slice, with column ``slice``."""
    return df.withColumn("slice", error_kind()).where(F.col("slice").isNotNull())


def error_counts(df: DataFrame) -> DataFrame:
    return error_slices(df).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


def error_sample(df: DataFrame, kind: str, columns: Sequence[str] = SAMPLE_COLUMNS, n: int = 10, key: str = "trans_num") -> DataFrame:
    """n rows of a slice, highest score first, with those of ``columns`` that exist."""
    present = [c for c in columns if c in df.columns]
    return df.where(error_kind() == kind).orderBy(F.desc("score"), F.asc(key)).limit(n).select(key, *present)


def error_means(df: DataFrame, columns: Sequence[str] = COMPARED_COLUMNS) -> DataFrame:
    """(feature, fp_mean, fn_mean, tp_mean) to 3 places, in one scan."""
    present = [c for c in columns if c in df.columns]
    kind = F.col("_kind")

    def mean(c: str, k: str):
        return F.round(F.avg(F.when(kind == k, F.col(c))), 3).alias(f"{k.lower()}_mean")

    rows = [F.struct(F.lit(c).alias("feature"), *[mean(c, k) for k in ("FP", "FN", "TP")]) for c in present]
    return df.withColumn("_kind", error_kind()).agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def dependence(df: DataFrame, feature: str, bins: int = 20, score: str = "score") -> DataFrame:
    """Mean score per equal-width bin of a feature."""
    ends = df.agg(F.min(feature).alias("_lo"), F.max(feature).alias("_hi"))
    placed = with_row(df.where(F.col(feature).isNotNull()), ends)
    placed = placed.withColumn("bin", equal_width_bin(F.col(feature).cast("double"), F.col("_lo"), F.col("_hi"), bins))
    return placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(feature).alias("feature_mean"), F.avg(score).alias("score_mean")
    )
