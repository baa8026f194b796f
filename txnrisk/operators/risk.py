"""Composite risk score, rule flags, log and interaction features."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import flag
from txnrisk.plans.scalars import with_row
from txnrisk.schema import RISK_WEIGHTS

INVERTED = "DeviceTrustScore"
PERCENT_SCALE_ABOVE = 1.5


def _signal(name: str) -> Column:
    value = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return 100.0 - value if name == INVERTED else value


def fit_risk_scales(df: DataFrame, weights: Mapping[str, float] = RISK_WEIGHTS) -> dict[str, float]:
    """Divisor per signal: 100 where the data set's largest value shows a percent scale, else 1 (one narrow scan)."""
    peaks = df.agg(*[F.max(_signal(c)).alias(c) for c in weights]).first()
    return {c: 100.0 if (peaks[c] or 0.0) > PERCENT_SCALE_ABOVE else 1.0 for c in weights}


def add_risk_score(
    df: DataFrame,
    scales: Mapping[str, float] | None = None,
    weights: Mapping[str, float] = RISK_WEIGHTS,
    source: DataFrame | None = None,
) -> DataFrame:
    """RiskSignalWeightedScore. Without ``scales`` they come from ``source`` (default: the table) as a scalar subquery."""
    if scales is not None:
        score = sum((F.lit(w) * _signal(c) / F.lit(scales[c]) for c, w in weights.items()), F.lit(0.0))
        return df.withColumn("RiskSignalWeightedScore", F.round(score, 4))
    fitted = (df if source is None else source).agg(
        F.struct(*[F.when(F.max(_signal(c)) > PERCENT_SCALE_ABOVE, 100.0).otherwise(1.0).alias(c) for c in weights]).alias("_scale")
    )
    score = sum((F.lit(w) * _signal(c) / F.col(f"_scale.{c}") for c, w in weights.items()), F.lit(0.0))
    joined = with_row(df, fitted)
    return joined.withColumn("RiskSignalWeightedScore", F.round(score, 4)).drop("_scale")


def add_device_features(df: DataFrame, shared_accounts: int = 3) -> DataFrame:
    """DeviceClusterSize and LinkedFraudAccounts."""
    accounts = F.col("NumAccountsOnDevice")
    return df.withColumns(
        {
            "DeviceClusterSize": F.coalesce(accounts.cast("int"), F.lit(1)),
            "LinkedFraudAccounts": flag((accounts > shared_accounts) & (F.col("PreviousFraudFlag") == 1)),
        }
    )


def add_logs_and_interactions(df: DataFrame) -> DataFrame:
    """log1p features and three products; expects the travel, velocity and z-score columns."""
    return df.withColumns(
        {
            "log_amt": F.log1p("amt"),
            "log_DistanceFromHome": F.log1p("DistanceFromHome"),
            "log_TimeSinceLastTxn": F.log1p(F.coalesce("TimeSinceLastTxnSec", F.lit(0.0))),
            "log_TxnAmount_7d": F.log1p(F.coalesce("TxnAmount_7d", F.lit(0.0))),
            "IsNewDevice_x_IPRisk": F.round(F.col("IsNewDevice") * F.col("IPRiskScore"), 4),
            "IsVPN_x_AmtZScore": F.round(F.col("IsVPN") * F.abs("AmountZScore"), 4),
            "Bot_x_Velocity": F.round(F.col("BotLikelihoodScore") * F.col("TxnCount_1h"), 4),
        }
    )


class FlagLimits(NamedTuple):
    """Thresholds of the rule flags; they are this package's defaults."""

    velocity_count_1h: int = 3
    high_amount_z: float = 2.0
    bot_score: float = 0.7
    new_account_days: int = 30
    device_accounts: int = 3


def rule_flags(limits: FlagLimits = FlagLimits()) -> dict[str, Column]:
    """The ten boolean rule flags, null-safe, as 0/1."""
    c = F.col
    return {
        "Rule_HighVelocity": flag(c("TxnCount_1h") >= limits.velocity_count_1h),
        "Rule_CountryMismatch": flag(c("IPCountryMismatch") == 1),
        "Rule_NewDeviceHighAmount": flag((c("IsNewDevice") == 1) & (c("AmountZScore") >= limits.high_amount_z)),
        "Rule_DisposableEmail": flag(c("IsDisposableEmail") == 1),
        "Rule_VPNorTor": flag((c("IsVPN") == 1) | (c("IsTor") == 1)),
        "Rule_BotLikely": flag(c("BotLikelihoodScore") >= limits.bot_score),
        "Rule_ImpossibleTravel": flag(c("ImpossibleTravelFlag") == 1),
        "Rule_SyntheticIdentity": flag(c("SyntheticIdentityFlag") == 1),
        "Rule_NewAccount": flag(c("AccountAgeDays") <= limits.new_account_days),
        "Rule_SharedDevice": flag(c("NumAccountsOnDevice") > limits.device_accounts),
    }


def add_rule_flags(df: DataFrame, limits: FlagLimits = FlagLimits()) -> DataFrame:
    """The ten flags and RiskSignalCount, the number of them that fired."""
    flags = rule_flags(limits)
    return df.withColumns(flags).withColumn("RiskSignalCount", sum((F.col(n) for n in flags), F.lit(0)))
