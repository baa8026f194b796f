"""Enrichment joins and the final feature tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.account import LOGIN_COLUMNS, add_password_features, login_history
from txnrisk.operators.merchant import add_merchant_features
from txnrisk.operators.profile import (
    amount_zscore,
    category_deviation,
    inter_arrival_entropy,
    period_stats,
    time_of_day_deviation,
)
from txnrisk.operators.risk import add_device_features, add_logs_and_interactions, add_risk_score
from txnrisk.operators.sequence import previous_location, time_since_last, travel_features
from txnrisk.operators.velocity import amount_deviation, burst_ratios, velocity
from txnrisk.plans.hotkeys import HEAVY_ROWS, run_steps
from txnrisk.plans.scalars import with_row
from txnrisk.schema import DERIVED_FEATURES


def duplicate_keys(feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count: empty for a usable feed."""
    return feed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def assemble(txn: DataFrame, feeds: Mapping[str, tuple[DataFrame, Sequence[str]]], check: bool = False) -> DataFrame:
    """Left-join every feed {name: (table, keys)}; the row count of ``txn`` is kept when feed keys are unique.

    ``check`` counts duplicates of each feed first and raises on any. Join strategy is left to the planner:
    feeds below the broadcast limit cost no shuffle, larger ones get adaptive skew handling.
    """
    out = txn
    for name, (feed, keys) in feeds.items():
        if check and not duplicate_keys(feed, keys).isEmpty():
            raise ValueError(f"feed {name!r} has duplicate keys on {list(keys)}")
        out = out.join(feed, list(keys), "left")
    return out


def with_global(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """Whole-table statistics on every row, through a scalar subquery."""
    return with_row(df, df.agg(*[a.alias(n) for n, a in aggs.items()]))


def enrich_codes(df: DataFrame, codes: DataFrame, column: str, key: str, value: str, name: str) -> DataFrame:
    """Look a column up in a dictionary table; unmatched gives null."""
    lookup = codes.select(F.col(key).alias("_code"), F.col(value).alias(name))
    return df.join(lookup, F.col(column) == F.col("_code"), "left").drop("_code")


def card_features(df: DataFrame, cutoff: int, logins: DataFrame | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """All per-card features behind one heavy-key split: ordinary cards share their exchange by card.

    Steps in time order come first and share one sort as well.
    """
    steps = [
        previous_location(),
        velocity(),
        amount_deviation(),
        time_since_last(),
        travel_features(),
        inter_arrival_entropy(),
        period_stats(cutoff),
        amount_zscore(),
        time_of_day_deviation(),
        category_deviation(),
        burst_ratios(),
    ]
    feeds = {}
    if logins is not None:
        steps.insert(0, login_history())
        feeds["logins"] = logins.select(*LOGIN_COLUMNS)
    return run_steps(df, steps, min_rows=heavy_rows, feeds=feeds)


def derive_features(df: DataFrame, cutoff: int, logins: DataFrame | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Input columns plus every derived feature.

    Needs the transaction, score, device and ``TransactionHour`` columns, and ``DaysSincePasswordChange`` unless
    ``logins`` gives the login feed to derive it from. Merchant statistics and score scales come straight from
    the input, so they run beside the card windows.
    """
    out = card_features(df, cutoff, logins, heavy_rows)
    out = add_merchant_features(out, source=df)
    out = add_risk_score(out, source=df)
    return add_logs_and_interactions(add_device_features(add_password_features(out)))


def feature_table(df: DataFrame, key: str = "trans_num", label: str = "is_fraud") -> DataFrame:
    """Key, the derived features in fixed order, label."""
    return df.select(key, *DERIVED_FEATURES, label)


def validate_features(df: DataFrame, columns: Sequence[str], label: str = "is_fraud") -> DataFrame:
    """Average of each feature (fire rate of a 0/1 rule) for label 0 and 1: one scan, one row per feature."""
    means = [
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(F.when(F.col(label) == 0, F.col(c))).alias("legit_avg"),
            F.avg(F.when(F.col(label) == 1, F.col(c))).alias("fraud_avg"),
        )
        for c in columns
    ]
    return df.agg(F.array(*means).alias("rows")).select(F.inline("rows"))
