"""Scores to decisions, decision records and their display form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.schema import DECISION_SCHEMA, DECLINE_THRESHOLD, REVIEW_SHARE, REVIEW_THRESHOLD

SERVING_LABELS = ("APPROVE", "REVIEW", "DECLINE")
TRAINING_LABELS = ("approve", "review", "decline")


def _score(score: Column | str) -> Column:
    return F.col(score) if isinstance(score, str) else score


def decide(
    score: Column | str,
    decline: float | Column = DECLINE_THRESHOLD,
    review: float | Column = REVIEW_THRESHOLD,
    labels: tuple[str, str, str] = SERVING_LABELS,
) -> Column:
    """Decline from ``decline`` on, review from ``review`` on, else approve (thresholds belong to the upper tier)."""
    s = _score(score)
    return F.when(s >= decline, F.lit(labels[2])).when(s >= review, F.lit(labels[1])).otherwise(F.lit(labels[0]))


def decide_share(score: Column | str, threshold: float | Column, share: float = REVIEW_SHARE) -> Column:
    """Evaluation policy: review from share · threshold on, lower-case labels."""
    return decide(score, threshold, threshold * share, TRAINING_LABELS)


def decide_cut(score: Column | str, threshold: float | Column, share: float = REVIEW_SHARE) -> Column:
    """Batch scoring policy: right-closed tiers, a score equal to a threshold stays in the lower one."""
    s = _score(score)
    return (
        F.when(s <= threshold * share, F.lit(TRAINING_LABELS[0]))
        .when(s <= threshold, F.lit(TRAINING_LABELS[1]))
        .when(s.isNotNull(), F.lit(TRAINING_LABELS[2]))
    )


def decision_record(
    df: DataFrame, score: str = "fraud_score", decline: float = DECLINE_THRESHOLD, review: float = REVIEW_THRESHOLD, scored_at: Column | None = None
) -> DataFrame:
    """The stored decision: ids, amount, score to 6 places, decision, label (-1 unknown), scoring time.

    The decision is taken on the unrounded score. ``scored_at`` defaults to one stamp per batch.
    """
    label = F.col("is_fraud") if "is_fraud" in df.columns else F.lit(None)
    out = df.select(
        "trans_num",
        "cc_num",
        "merchant",
        "unix_time",
        "amt",
        F.round(score, 6).alias("fraud_score"),
        decide(score, decline, review).alias("decision"),
        F.coalesce(label, F.lit(-1)).cast("int").alias("is_fraud_actual"),
        (F.current_timestamp() if scored_at is None else scored_at).alias("scored_at"),
    )
    return out.select(*[F.col(c) for c in DECISION_SCHEMA.names])


def format_decisions(df: DataFrame) -> DataFrame:
    """Display columns: time of day, 6-digit score, dollar amount; renamed for reading."""
    return df.select(
        F.date_format("scored_at", "HH:mm:ss").alias("time"),
        "trans_num",
        "merchant",
        F.concat(F.lit("$"), F.format_number("amt", 2)).alias("amt"),
        F.format_string("%.6f", F.col("fraud_score")).alias("fraud_score"),
        "decision",
        F.col("is_fraud_actual").alias("actual_fraud"),
    )


def hour_label(df: DataFrame) -> DataFrame:
    """Adds ``hour_label`` like ``2024-01-01 07:00`` to an hourly rollup."""
    hour = F.lpad(F.col("decision_hour").cast("string"), 2, "0")
    return df.withColumn("hour_label", F.concat(F.col("decision_date").cast("string"), F.lit(" "), hour, F.lit(":00")))
