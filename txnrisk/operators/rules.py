"""Business rules: library, per-rule statistics in one scan, ranking, tiers and coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions import safe_ratio

# Rule label -> predicate, in library order.
RULES = {
    "IsTor = 1": "IsTor = 1",
    "IsVPN = 1": "IsVPN = 1",
    "IP Country Mismatch": "IPCountryMismatch = 1",
    "Disposable Email": "IsDisposableEmail = 1",
    "Synthetic Identity": "SyntheticIdentityFlag = 1",
    "Previous Fraud Flag": "PreviousFraudFlag = 1",
    "Impossible Travel": "ImpossibleTravelFlag = 1",
    "Device Blacklisted": "DeviceBlacklisted = 1",
    "VOIP Phone": "IsVOIP = 1",
    "Chargebacks >= 3": "ChargebackCount >= 3",
    "New Device": "IsNewDevice = 1",
    "Bot Score >= 0.7": "BotLikelihoodScore >= 0.7",
    "Bot Score >= 0.9": "BotLikelihoodScore >= 0.9",
    "Amount Z-Score >= 3": "AmountZScore >= 3",
    "30d Amount Dev >= 3": "AmountDeviation_30d >= 3",
    "Spend Burst >= 10": "SpendBurstScore >= 10",
    "IP Risk >= 70": "IPRiskScore >= 70",
    "IP Risk >= 85": "IPRiskScore >= 85",
    "Account Age <= 7d": "AccountAgeDays <= 7",
    "Account Age <= 30d": "AccountAgeDays <= 30",
    "SSN Match <= 0.4": "SSNMatchScore <= 0.4",
    "Risk Signal Count >= 3": "RiskSignalCount >= 3",
    "Risk Signal Count >= 5": "RiskSignalCount >= 5",
    "VPN + New Device": "IsVPN = 1 AND IsNewDevice = 1",
    "VPN + High Amount": "IsVPN = 1 AND AmountZScore >= 2",
    "New Device + High Amount": "IsNewDevice = 1 AND AmountZScore >= 2",
    "Country Mismatch + New Device": "IPCountryMismatch = 1 AND IsNewDevice = 1",
    "Bot + New Device": "BotLikelihoodScore >= 0.7 AND IsNewDevice = 1",
    "Disposable Email + New Account": "IsDisposableEmail = 1 AND AccountAgeDays <= 30",
    "Synthetic ID + Any Chargeback": "SyntheticIdentityFlag = 1 AND ChargebackCount >= 1",
    "TOR or VPN or Country Mismatch": "IsTor = 1 OR IsVPN = 1 OR IPCountryMismatch = 1",
    "Risk Count>=3 + High Amount": "RiskSignalCount >= 3 AND AmountZScore >= 2",
    "Bot + Spend Burst>=5": "BotLikelihoodScore >= 0.7 AND SpendBurstScore >= 5",
}

# Rules of each action tier.
DECLINE_RULES = [
    "IsTor = 1",
    "Synthetic Identity",
    "Bot Score >= 0.9",
    "Synthetic ID + Any Chargeback",
    "VPN + New Device",
    "Risk Signal Count >= 5",
]
REVIEW_RULES = [
    "IsVPN = 1",
    "IP Country Mismatch",
    "Impossible Travel",
    "Disposable Email",
    "Bot Score >= 0.7",
    "Chargebacks >= 3",
    "Country Mismatch + New Device",
    "Bot + New Device",
    "30d Amount Dev >= 3",
    "Risk Signal Count >= 3",
    "Disposable Email + New Account",
]
MONITOR_RULES = [
    "Account Age <= 7d",
    "VOIP Phone",
    "New Device",
    "IP Risk >= 70",
    "SSN Match <= 0.4",
    "Spend Burst >= 10",
]


def fires(predicate: str) -> Column:
    """Rule condition where unknown counts as not met; predicates have no NOT, so one guard on the outside is enough."""
    return F.coalesce(F.expr(predicate), F.lit(False))


def any_fires(labels: Sequence[str], rules: Mapping[str, str] = RULES) -> Column:
    return F.coalesce(F.expr(" OR ".join(f"({rules[r]})" for r in labels)), F.lit(False))


def action_label(rule: Column | str) -> Column:
    """DECLINE, REVIEW, and MONITOR for everything else."""
    rule = F.col(rule) if isinstance(rule, str) else rule
    return F.when(rule.isin(DECLINE_RULES), "DECLINE").when(rule.isin(REVIEW_RULES), "REVIEW").otherwise("MONITOR")


def rule_stats(df: DataFrame, rules: Mapping[str, str] = RULES, label: str = "is_fraud") -> DataFrame:
    """Per rule: flagged, tp, precision, recall, f1, lift, fpr (4 places, lift 2). All rules in one scan.

    The rules that a row fires are the bits of one number. Rows collapse to (number, label) on the map side, and only those few
    unfold to rules. A rule that always fires, at position -1, counts the classes on the way.
    """
    if len(rules) > 62:
        raise ValueError("at most 62 rules fit one number")
    bits = sum((F.when(fires(p), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, p in enumerate(rules.values())), F.lit(1 << len(rules)).cast("long"))
    sets = df.groupBy(F.col(label).alias("_label"), bits.alias("_bits")).agg(F.count(F.lit(1)).alias("_n"))
    places = F.array(*[F.struct(F.lit(-1 if i == len(rules) else i).alias("position"), F.lit(i).alias("_bit")) for i in range(len(rules) + 1)])
    counts = (
        sets.select("*", F.inline(places))
        .where(F.expr("shiftright(_bits, _bit) % 2 = 1"))
        .groupBy("position")
        .agg(
            F.sum("_n").alias("flagged"),
            F.coalesce(F.sum(F.when(F.col("_label") == 1, F.col("_n"))), F.lit(0)).alias("tp"),
            F.coalesce(F.sum(F.when(F.col("_label") == 0, F.col("_n"))), F.lit(0)).alias("fp"),
        )
    )
    # At most one entry per rule from here on; rules that never fire are absent.
    table = counts.agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("flagged", "tp", "fp")))).alias("found"))
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("rule")) for i, n in enumerate(rules)])
    listed = table.select("found", F.inline(names))
    own, every = F.try_element_at("found", F.col("position")), F.try_element_at("found", F.lit(-1))

    def number(entry: Column, field: str) -> Column:
        return F.coalesce(entry[field], F.lit(0))

    counted = listed.select(
        "position",
        "rule",
        *[number(own, f).alias(f) for f in ("flagged", "tp", "fp")],
        number(every, "tp").alias("n_fraud"),
        number(every, "fp").alias("n_legit"),
    ).withColumn("baseline", F.try_divide(F.col("n_fraud"), F.col("n_fraud") + F.col("n_legit")))
    precision, recall = F.col("_precision"), F.col("_recall")
    exact = counted.withColumns(
        {
            "_precision": safe_ratio("tp", F.col("tp") + F.col("fp")),
            "_recall": safe_ratio("tp", "n_fraud"),
            "_fpr": safe_ratio("fp", "n_legit"),
        }
    )
    return exact.select(
        "position",
        "rule",
        "flagged",
        "tp",
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(safe_ratio(2 * precision * recall, precision + recall), 4).alias("f1"),
        F.round(safe_ratio(precision, "baseline"), 2).alias("lift"),
        F.round("_fpr", 4).alias("fpr"),
        "baseline",
    )


def rank_rules(stats: DataFrame) -> DataFrame:
    """Adds ``rank`` 1..n by lift; equal lifts keep library order. The input has one row per rule."""
    order = Window.orderBy(F.desc("lift"), F.asc("position"))
    return stats.withColumn("rank", F.row_number().over(order))


def rule_points(stats: DataFrame) -> DataFrame:
    """Precision / recall points with lift, false-positive rate and the base rate."""
    return stats.select("rule", "recall", "precision", "lift", "fpr", "baseline")


def rule_summary(stats: DataFrame) -> DataFrame:
    """Tiered rules with percentages, by action and then falling lift."""
    listed = stats.where(F.col("rule").isin(DECLINE_RULES + REVIEW_RULES + MONITOR_RULES))
    return listed.select(
        action_label("rule").alias("action"),
        "rule",
        "flagged",
        "tp",
        F.round(F.col("precision") * 100, 2).alias("precision_pct"),
        F.round(F.col("recall") * 100, 2).alias("recall_pct"),
        "lift",
        F.round(F.col("fpr") * 100, 3).alias("fpr_pct"),
        "f1",
    ).orderBy(F.asc("action"), F.desc("lift"), F.asc("rule"))


def tier_coverage(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Fraud caught and legit affected by the decline tier and by review alone, what is missed, combined recall."""
    fraud, legit = F.col(label) == 1, F.col(label) == 0
    decline = any_fires(DECLINE_RULES)
    review_only = any_fires(REVIEW_RULES) & ~decline
    counts = df.agg(
        F.count_if(fraud).alias("total_fraud"),
        F.count_if(legit).alias("total_legit"),
        F.count_if(decline & fraud).alias("decline_fraud"),
        F.count_if(decline & legit).alias("decline_legit"),
        F.count_if(review_only & fraud).alias("review_fraud"),
        F.count_if(review_only & legit).alias("review_legit"),
    )
    missed = F.col("total_fraud") - F.col("decline_fraud") - F.col("review_fraud")

    def share(part, whole):
        return F.round(safe_ratio(part, whole), 6)

    return counts.withColumns(
        {
            "missed_fraud": missed,
            "decline_recall": share("decline_fraud", "total_fraud"),
            "decline_fpr": share("decline_legit", "total_legit"),
            "review_recall": share("review_fraud", "total_fraud"),
            "review_share_legit": share("review_legit", "total_legit"),
            "missed_share": share(missed, "total_fraud"),
            "combined_recall": share(F.col("decline_fraud") + F.col("review_fraud"), "total_fraud"),
        }
    )
