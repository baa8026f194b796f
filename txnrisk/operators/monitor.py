"""Monitoring reads over the decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.plans.scalars import with_row


def latest_decisions(log: DataFrame, n: int = 500) -> DataFrame:
    """The n newest decisions, newest first; equal stamps by transaction, falling."""
    return log.orderBy(F.desc("scored_at"), F.desc("trans_num")).limit(n)


def kpis(log: DataFrame) -> DataFrame:
    """One row of headline figures, none for an empty log. Unknown labels count in the base of the fraud rate."""
    decision = F.col("decision")
    counts = log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(decision == "DECLINE").alias("declined"),
        F.count_if(decision == "REVIEW").alias("review"),
        F.count_if(decision == "APPROVE").alias("approved"),
        F.count_if(F.col("is_fraud_actual") == 1).alias("actual_fraud"),
        F.avg("fraud_score").alias("avg_score"),
        F.coalesce(F.sum(F.when(decision == "DECLINE", F.col("amt"))), F.lit(0.0)).alias("blocked_amount"),
    )
    return counts.where("total > 0").withColumns(
        {
            "fraud_rate_pct": F.col("actual_fraud") / F.col("total") * 100,
            "decline_rate_pct": F.col("declined") / F.col("total") * 100,
        }
    )


def hourly_rollup(log: DataFrame) -> DataFrame:
    """(decision_date, decision_hour, approved, reviewed, declined) per UTC hour, in time order."""
    decision = F.col("decision")
    return (
        log.groupBy(F.to_date("scored_at").alias("decision_date"), F.hour("scored_at").alias("decision_hour"))
        .agg(
            F.count_if(decision == "APPROVE").alias("approved"),
            F.count_if(decision == "REVIEW").alias("reviewed"),
            F.count_if(decision == "DECLINE").alias("declined"),
        )
        .orderBy("decision_date", "decision_hour")
    )


def decision_counts(log: DataFrame, decision: str = "decision") -> DataFrame:
    return log.groupBy(decision).agg(F.count(F.lit(1)).alias("n"))


def decision_summary(scored: DataFrame, decision: str = "decision", label: str = "is_fraud") -> DataFrame:
    """Per decision, lightest first: labelled rows, fraud, rate, share of all rows."""
    counted = scored.groupBy(decision).agg(
        F.count(label).alias("n"), F.sum(label).alias("fraud"), F.count(F.lit(1)).alias("_rows")
    )
    total = scored.agg(F.count(F.lit(1)).alias("_total"))
    position = F.array_position(F.array(*[F.lit(d) for d in ("approve", "review", "decline")]), F.lower(F.col(decision)))
    return (
        with_row(counted, total)
        .select(
            decision,
            "n",
            "fraud",
            F.try_divide(F.col("fraud"), F.col("n")).alias("fraud_rate"),
            (F.col("n") / F.col("_total")).alias("pct_of_total"),
            position.alias("position"),
        )
        .orderBy("position")
        .drop("position")
    )
