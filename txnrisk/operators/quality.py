"""Profiling of a labelled table: class balance, nulls, amounts, group rates, flags, description."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions import clip
from txnrisk.plans.ranked import exact_quantiles
from txnrisk.plans.scalars import with_row

LABEL = "is_fraud"


def numeric_columns(schema: T.StructType, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: rows, fraud, legit, fraud rate, legit per fraud (null without fraud)."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == 1).alias("fraud"), F.count_if(F.col(label) == 0).alias("legit")
    )
    return counts.withColumns(
        {
            "fraud_rate": F.try_divide(F.col("fraud"), F.col("total")),
            "legit_rate": F.try_divide(F.col("legit"), F.col("total")),
            "imbalance_ratio": F.try_divide(F.col("legit"), F.col("fraud")),
        }
    )


def label_counts(tables: dict[str, DataFrame], label: str = LABEL) -> DataFrame:
    """(dataset, label, n) over several tables."""
    parts = [df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("dataset", label, "n")


def null_profile(df: DataFrame, n: int = 20) -> DataFrame:
    """Null count and percentage of the columns that have any, most first; one scan for all columns."""

    def missing(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()

    counters = [F.struct(F.lit(f.name).alias("column"), F.count_if(missing(f)).alias("null_count")) for f in df.schema]
    counted = df.agg(F.array(*counters).alias("columns"), F.count(F.lit(1)).alias("_rows"))
    return (
        counted.select("_rows", F.inline("columns"))
        .where("null_count > 0")
        .select("column", "null_count", F.round(F.col("null_count") * 100 / F.col("_rows"), 2).alias("null_pct"))
        .orderBy(F.desc("null_count"), F.asc("column"))
        .limit(n)
    )


def amount_summary(df: DataFrame, amount: str = "amt", label: str = LABEL, approx: bool = False) -> DataFrame:
    """Per class: mean, median, 95th percentile (linear interpolation), maximum.

    Exact quantiles come from ranked totals over distinct amounts; ``approx`` uses a mergeable sketch in one pass.
    """
    known = df.where(F.col(label).isNotNull())
    basics = [F.avg(amount).alias("mean"), F.max(amount).alias("max")]
    if approx:
        return known.groupBy(label).agg(
            *basics, F.percentile_approx(amount, 0.5).alias("median"), F.percentile_approx(amount, 0.95).alias("p95")
        )
    quantiles = exact_quantiles(known, amount, {"median": 0.5, "p95": 0.95}, by=[label])
    # Both sides hold one row per class.
    return known.groupBy(label).agg(*basics).join(quantiles, label)


def winsorise(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip a column to its own quantiles and drop nulls; the bounds are a scalar subquery."""
    bounds = exact_quantiles(df, column, {"_low": low, "_high": high})
    clipped = with_row(df.where(F.col(column).isNotNull()), bounds)
    return clipped.withColumn(column, clip(column, F.col("_low"), F.col("_high"))).drop("_low", "_high")


def rate_by(df: DataFrame, column: str, baseline: str = "overall", label: str = LABEL) -> DataFrame:
    """Fraud sum, count and rate per value, and whether it is above the overall rate or above the mean of the group rates."""
    groups = df.where(F.col(column).isNotNull()).groupBy(column)
    rates = groups.agg(F.sum(label).alias("fraud"), F.count(label).alias("n")).withColumn("fraud_rate", F.try_divide(F.col("fraud"), F.col("n")))
    base = df.agg(F.avg(label).alias("baseline")) if baseline == "overall" else rates.agg(F.avg("fraud_rate").alias("baseline"))
    joined = with_row(rates, base)
    return joined.withColumn("above_avg", (F.col("fraud_rate") > F.col("baseline")).cast("int"))


def night_day_rate(df: DataFrame, label: str = LABEL) -> DataFrame:
    rates = rate_by(df, "IsNightTxn", label=label)
    name = F.when(F.col("IsNightTxn") == 1, "Night (midnight-5am)").otherwise("Day (6am-11pm)")
    return rates.select(name.alias("period"), "fraud", "n", "fraud_rate")


def top_n(df: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """Rows with the largest ``by``; ``tie`` orders equal ones."""
    return df.orderBy(F.desc(by), F.asc(tie)).limit(n)


def top_rates(df: DataFrame, column: str, n: int = 5, label: str = LABEL) -> DataFrame:
    return top_n(rate_by(df, column, label=label).select(column, "fraud", "n", "fraud_rate"), "fraud_rate", n, column)


def flag_rates(df: DataFrame, flags: Sequence[str], label: str = LABEL) -> DataFrame:
    """Per 0/1 column that is ever set: fraud rate when set, coverage, count, risk band. All columns in one scan."""
    present = [c for c in flags if c in df.columns]
    counters = [
        F.struct(
            F.lit(c).alias("flag"),
            F.avg(F.when(F.col(c) == 1, F.col(label))).alias("fraud_rate_when_flagged"),
            F.count_if(F.col(c) == 1).alias("flagged_count"),
        )
        for c in present
    ]
    counted = df.agg(F.array(*counters).alias("flags"), F.count(F.lit(1)).alias("_rows"))
    rate = F.col("fraud_rate_when_flagged")
    return (
        counted.select("_rows", F.inline("flags"))
        .where("flagged_count > 0")
        .select(
            "flag",
            "fraud_rate_when_flagged",
            (F.col("flagged_count") / F.col("_rows")).alias("coverage"),
            "flagged_count",
            F.when(rate > 0.05, "high").when(rate > 0.01, "medium").otherwise("low").alias("band"),
        )
    )


def describe_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, mean, std, min, max) per numeric column in one scan: rows unfold to (feature, value) and fold on the map side."""
    columns = list(columns or numeric_columns(df.schema))
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("feature")
        .agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    )
