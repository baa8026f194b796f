"""Merchant-level statistics joined back to transactions.

Statistics are aggregated once (map-side combine) and stored, so the joined side has one row per merchant. It is measured: up
to MERCHANT_BYTES it is broadcast and the wide rows are not shuffled; beyond, only rows of ordinary merchants
are, and heavy merchants are joined by a bounded broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import or_one, safe_ratio
from txnrisk.plans.joins import JOIN_HEAVY_ROWS, attach_stats

MERCHANT_BYTES = 64_000_000


def merchant_stats(df: DataFrame, cutoff: int | None = None) -> DataFrame:
    """(merchant, merch_avg, merch_std, SharedMerchantFraudRate); ``cutoff`` keeps only earlier rows."""
    source = df if cutoff is None else df.where(F.col("unix_time") < cutoff)
    known = source.where(F.col("merchant").isNotNull())
    return known.groupBy("merchant").agg(
        F.avg("amt").alias("merch_avg"),
        F.stddev_samp("amt").alias("merch_std"),
        safe_ratio(F.sum("is_fraud"), F.count("is_fraud")).alias("SharedMerchantFraudRate"),
    )


def _join(df: DataFrame, stats: DataFrame) -> DataFrame:
    return attach_stats(df, stats, ["merchant"], MERCHANT_BYTES, heavy_rows=JOIN_HEAVY_ROWS)


def _z() -> Column:
    return F.round((F.col("amt") - F.col("merch_avg")) / or_one("merch_std"), 4)


def add_merchant_zscore(df: DataFrame, cutoff: int | None = None) -> DataFrame:
    """MerchantAmountZScore; null for an unknown merchant."""
    stats = merchant_stats(df, cutoff).drop("SharedMerchantFraudRate")
    return _join(df, stats).withColumn("MerchantAmountZScore", _z()).drop("merch_avg", "merch_std")


def add_merchant_fraud_rate(df: DataFrame, cutoff: int | None = None) -> DataFrame:
    """SharedMerchantFraudRate: labelled fraud over labelled rows of the merchant."""
    return _join(df, merchant_stats(df, cutoff).select("merchant", "SharedMerchantFraudRate"))


def add_merchant_features(df: DataFrame, source: DataFrame | None = None, cutoff: int | None = None) -> DataFrame:
    """Both merchant features with one aggregate and one join; ``source`` is the table to take statistics from."""
    out = _join(df, merchant_stats(df if source is None else source, cutoff))
    return out.withColumn("MerchantAmountZScore", _z()).drop("merch_avg", "merch_std")


def merchant_fraud_rates(df: DataFrame, cutoff: int) -> DataFrame:
    """Per merchant: fraud rate of the train period next to the all-time one, with row counts."""
    early = F.col("unix_time") < cutoff
    label = F.col("is_fraud")
    return (
        df.where(F.col("merchant").isNotNull())
        .groupBy("merchant")
        .agg(
            F.count(F.when(early, label)).alias("train_txns"),
            F.avg(F.when(early, label)).alias("train_fraud_rate"),
            F.count(label).alias("all_txns"),
            F.avg(label).alias("all_fraud_rate"),
        )
    )
