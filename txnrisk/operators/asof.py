"""Features as they stand when a transaction is scored: profiles of the train period, and the card's own past.

A transaction's features come from two places. Profiles (means and spreads of cards, hours, categories and merchants, gap entropy, merchant
fraud rates) are fitted once on the train period and stored with the model; rows of the train period, the holdout and live rows look
them up with the same code. Everything else comes from the card's earlier transactions and logins, so batch windows and the online state of
``streaming.features`` give the same values, and nothing of the holdout, labels included, reaches a row.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import equal_width_bin, or_one, safe_ratio
from txnrisk.operators.account import LOGIN_COLUMNS, add_password_features, login_history
from txnrisk.operators.merchant import merchant_stats
from txnrisk.operators.profile import MAX_GAP_BINS
from txnrisk.operators.risk import add_device_features, add_logs_and_interactions, add_risk_score, add_rule_flags, fit_risk_scales
from txnrisk.operators.sequence import LINEAR_HEAVY_ROWS, inter_arrival_gaps, previous_location, time_since_last, travel_features
from txnrisk.operators.velocity import amount_deviation, burst_ratios, velocity
from txnrisk.plans.hotkeys import HEAVY_ROWS, Step, run_steps
from txnrisk.plans.joins import attach_stats
from txnrisk.session import materialise


class Profiles(NamedTuple):
    """One row per card, per card and category, per merchant; and the divisors of the composite risk score."""

    cards: DataFrame
    pairs: DataFrame
    merchants: DataFrame
    scales: Mapping[str, float]


#: Keys of the three tables.
PROFILE_KEYS = {"cards": ["cc_num"], "pairs": ["cc_num", "MerchantCategory"], "merchants": ["merchant"]}


def gap_entropy(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    """(cc_num, InterArrivalEntropy) of cards with two gaps or more: bits of the gap histogram, at most 20 equal-width bins."""
    gaps = inter_arrival_gaps(df, heavy_rows).groupBy("cc_num", "gap_sec").agg(F.count(F.lit(1)).alias("_m"))
    # Equal gaps are one row now: a card's number of rows no longer matters.
    ends = gaps.groupBy("cc_num").agg(F.sum("_m").alias("_n"), F.min("gap_sec").alias("_lo"), F.max("gap_sec").alias("_hi"))
    ends = ends.where("_n >= 2").withColumnRenamed("cc_num", "_cc")
    both = gaps.join(ends, F.col("cc_num").eqNullSafe(F.col("_cc")))
    bins = F.least(F.lit(MAX_GAP_BINS), F.col("_n"))
    both = both.withColumn("_bin", equal_width_bin("gap_sec", F.col("_lo"), F.col("_hi"), bins))
    counts = both.groupBy("cc_num", "_n", "_bin").agg(F.sum("_m").alias("_c"))
    share = F.col("_c") / F.col("_n")
    return counts.groupBy("cc_num").agg((F.round(F.sum(-F.log2(share) * share), 4) + F.lit(0.0)).alias("InterArrivalEntropy"))


def fit_profiles(train: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> Profiles:
    """Profiles of the rows of the train period; every table is written once."""
    entropy = gap_entropy(train, heavy_rows).withColumnRenamed("cc_num", "_cc")
    cards = train.groupBy("cc_num").agg(
        F.avg("amt").alias("CardAvgAmt"),
        F.stddev_samp("amt").alias("CardStdAmt"),
        F.max("amt").alias("CardMaxAmt"),
        F.avg("TransactionHour").alias("_h_avg"),
        F.stddev_samp("TransactionHour").alias("_h_std"),
        F.count(F.lit(1)).alias("_card_n"),
    )
    cards = cards.join(entropy, F.col("cc_num").eqNullSafe(F.col("_cc")), "left").drop("_cc")
    pairs = train.where(F.col("MerchantCategory").isNotNull()).groupBy("cc_num", "MerchantCategory").agg(F.count(F.lit(1)).alias("_pair_n"))
    tables = {"cards": cards, "pairs": pairs, "merchants": merchant_stats(train)}
    return Profiles(**{name: materialise(t, f"profile-{name}") for name, t in tables.items()}, scales=fit_risk_scales(train))


def attach_profiles(df: DataFrame, profiles: Profiles) -> DataFrame:
    """Features against the profiles; amounts, hours and merchants without a profile give null, a category new to its card 1."""
    out = attach_stats(df, profiles.cards, PROFILE_KEYS["cards"])
    out = attach_stats(out, profiles.pairs, PROFILE_KEYS["pairs"])
    out = attach_stats(out, profiles.merchants, PROFILE_KEYS["merchants"])
    surprise = F.round(1 - safe_ratio(F.coalesce("_pair_n", F.lit(0)), F.coalesce("_card_n", F.lit(0))), 4)
    out = out.withColumns(
        {
            "AmountZScore": F.round((F.col("amt") - F.col("CardAvgAmt")) / or_one("CardStdAmt"), 4),
            "TimeOfDayDeviation": F.round((F.col("TransactionHour") - F.col("_h_avg")) / or_one("_h_std"), 4),
            "CategoryDeviationScore": F.when(F.col("MerchantCategory").isNotNull(), surprise).otherwise(F.lit(0.0)),
            "InterArrivalEntropy": F.coalesce("InterArrivalEntropy", F.lit(0.0)),
            "MerchantAmountZScore": F.round((F.col("amt") - F.col("merch_avg")) / or_one("merch_std"), 4),
        }
    )
    return out.drop("_h_avg", "_h_std", "_card_n", "_pair_n", "merch_avg", "merch_std")


def past_steps(logins: Step | None = None) -> list[Step]:
    """What a card's earlier rows and logins say about a row; steps in time order share one exchange and sort."""
    steps = [previous_location(), velocity(), amount_deviation(), time_since_last(), travel_features(), burst_ratios()]
    return [logins, *steps] if logins else steps


#: Columns that the steps over a card's past read.
PAST_COLUMNS = ["cc_num", "trans_num", "unix_time", "amt", "cust_lat", "cust_long", "merch_lat", "merch_long"]


def run_past(df: DataFrame, steps: list[Step], heavy_rows: int, feeds: Mapping[str, DataFrame], past: DataFrame | None = None) -> DataFrame:
    """Rows with what the steps add. The columns that no step reads pass the windows as one: each window copies every column it is given.

    ``past`` holds more rows of the cards, with some of PAST_COLUMNS; the steps see them, the result does not.
    """
    rest = [c for c in df.columns if c not in PAST_COLUMNS]
    packed = df.select(*PAST_COLUMNS, *([F.struct(*rest).alias("_rest")] if rest else []))
    if past is not None:
        packed = packed.withColumn("_past", F.lit(False)).unionByName(past.withColumn("_past", F.lit(True)), allowMissingColumns=True)
    out = run_steps(packed, steps, min_rows=heavy_rows, feeds=dict(feeds))
    if past is not None:
        out = out.where("NOT _past")
    # In the order that the steps give unpacked rows.
    given = ["cc_num", *[c for c in df.columns if c != "cc_num"]] if feeds else df.columns
    return out.select(*[F.col(f"_rest.{c}") if c in rest else c for c in given], *[c for c in out.columns if c not in packed.columns])


def past_features(df: DataFrame, logins: DataFrame | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Rows with what their card's past says."""
    feeds = {} if logins is None else {"logins": logins.select(*LOGIN_COLUMNS)}
    return run_past(df, past_steps(None if logins is None else login_history()), heavy_rows, feeds)


def finish_features(df: DataFrame, profiles: Profiles) -> DataFrame:
    """Everything that follows from the row, its past and the profiles: rows are not moved but for lookups."""
    out = add_risk_score(attach_profiles(df, profiles), profiles.scales)
    return add_rule_flags(add_logs_and_interactions(add_device_features(add_password_features(out))))


def derive_asof(df: DataFrame, profiles: Profiles, logins: DataFrame | None = None, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Input columns plus every derived feature and rule flag, with statistics of the train period only.

    Needs the columns that ``assemble.derive_features`` needs.
    """
    return finish_features(past_features(df, logins, heavy_rows), profiles)
