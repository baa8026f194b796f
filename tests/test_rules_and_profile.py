"""Rules, decisions, profiling: nulls, edges, invariants."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from txnrisk.operators import correlation, decide, histogram, monitor, quality, rules
from txnrisk.queries.features import wide_events
from txnrisk.queries.inputs import card_events, decision_log


@pytest.fixture(scope="module")
def wide(spark):
    return wide_events(spark, SMALL).cache()


def test_library_and_tiers():
    listed = rules.DECLINE_RULES + rules.REVIEW_RULES + rules.MONITOR_RULES
    assert len(rules.RULES) == 33 and len(listed) == len(set(listed)) == 23 and set(listed) <= set(rules.RULES)


def test_null_predicates_do_not_fire(spark):
    df = spark.createDataFrame([(None, 1, 1), (1, None, 0), (1, 1, None), (0, 1, 0)], "IsVPN int, IsNewDevice int, is_fraud int")
    used = {k: rules.RULES[k] for k in ("IsVPN = 1", "VPN + New Device")}
    got = {r["rule"]: r for r in rules.rule_stats(df, used).collect()}
    assert (got["IsVPN = 1"]["flagged"], got["IsVPN = 1"]["tp"]) == (2, 0)
    assert got["VPN + New Device"]["flagged"] == 1 and got["VPN + New Device"]["precision"] == 0.0


def test_rule_stats_against_counts(wide):
    rows = [r.asDict() for r in wide.select("IsTor", "AccountAgeDays", "is_fraud").collect()]
    got = {r["rule"]: r for r in rules.rule_stats(wide).collect()}
    flagged = [r for r in rows if r["AccountAgeDays"] <= 30]
    tp, fraud = sum(r["is_fraud"] for r in flagged), sum(r["is_fraud"] for r in rows)
    young = got["Account Age <= 30d"]
    assert (young["flagged"], young["tp"]) == (len(flagged), tp)
    assert young["recall"] == pytest.approx(tp / fraud, abs=1e-4)
    assert young["lift"] == pytest.approx(tp / len(flagged) / (fraud / len(rows)), abs=1e-2)


def test_rank_and_summary(wide):
    stats = rules.rule_stats(wide)
    ranks = rules.rank_rules(stats).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 34)) and all(a["lift"] >= b["lift"] for a, b in zip(ranks, ranks[1:], strict=False))
    summary = rules.rule_summary(stats).collect()
    assert [r["action"] for r in summary] == ["DECLINE"] * 6 + ["MONITOR"] * 6 + ["REVIEW"] * 11


def test_tiers_partition_fraud(wide):
    row = rules.tier_coverage(wide).first()
    assert row["decline_fraud"] + row["review_fraud"] + row["missed_fraud"] == row["total_fraud"]
    masks = wide.select(rules.any_fires(rules.DECLINE_RULES).alias("d"), rules.any_fires(rules.REVIEW_RULES).alias("r"))
    assert masks.where("d").count() == row["decline_fraud"] + row["decline_legit"]
    assert masks.where("r AND NOT d").count() == row["review_fraud"] + row["review_legit"]


def test_flags_are_zero_or_one(wide):
    flags = [c for c in wide.columns if c.startswith("Rule_")] + ["ImpossibleTravelFlag", "LinkedFraudAccounts"]
    assert len(flags) == 12
    assert wide.where(" OR ".join(f"{c} IS NULL OR {c} NOT IN (0, 1)" for c in flags)).isEmpty()
    assert wide.where("InterArrivalEntropy > log2(20) OR InterArrivalEntropy < 0").isEmpty()


def test_threshold_equality_per_policy(spark):
    df = spark.createDataFrame([(0.3,), (0.5,), (0.29,), (None,)], "s double")
    got = df.select(decide.decide("s", 0.5, 0.3).alias("a"), decide.decide_share("s", 0.5).alias("b"), decide.decide_cut("s", 0.5).alias("c")).collect()
    assert got[0] == ("REVIEW", "review", "approve") and got[1] == ("DECLINE", "decline", "review")
    assert got[2] == ("APPROVE", "approve", "approve") and got[3]["c"] is None


def test_record_defaults(spark):
    df = spark.createDataFrame([("x", 1, "m", 5, 2.0, 0.12345678)], "trans_num string, cc_num long, merchant string, unix_time long, amt double, fraud_score double")
    row = decide.decision_record(df).first()
    assert (row["fraud_score"], row["decision"], row["is_fraud_actual"]) == (0.123457, "APPROVE", -1) and row["scored_at"] is not None


def test_kpis_empty_and_unknown_labels(spark):
    log = decision_log(spark, SMALL)
    assert monitor.kpis(log.where("false")).isEmpty()
    unknown = log.withColumn("is_fraud_actual", F.when(F.col("trans_num") % 2 == 0, -1).otherwise(F.col("is_fraud_actual")))
    row = monitor.kpis(unknown).first()
    assert row["fraud_rate_pct"] == pytest.approx(row["actual_fraud"] / row["total"] * 100) and row["total"] == log.count()


def test_latest_is_newest_first(spark):
    rows = monitor.latest_decisions(decision_log(spark, SMALL), 20).collect()
    stamps = [(r["scored_at"], r["trans_num"]) for r in rows]
    assert stamps == sorted(stamps, reverse=True) and len(rows) == 20


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 1), (None, 5.0, 1), (4.0, 5.0, 1)], "x double, c double, is_fraud int")
    got = {r["feature"]: r["corr"] for r in correlation.label_correlation(df, ["x", "c"]).collect()}
    # complete pairs: x = 1, 2, 4 and y = 0, 1, 1
    assert got["x"] == pytest.approx(0.7559289, abs=1e-6) and got["c"] is None
    matrix = correlation.strongest_matrix(card_events(spark, SMALL), ["amt", "IsVPN", "IPRiskScore"], 2)
    assert matrix.count() == 3


def test_histogram_mass(spark):
    df = card_events(spark, SMALL)
    out = histogram.histogram(df, "fraud_score", 30, by="is_fraud", own_range=True).collect()
    assert sum(r["n"] for r in out) == df.count()
    for label in (0, 1):
        assert sum(r["density"] * (r["bin_high"] - r["bin_low"]) for r in out if r["is_fraud"] == label) == pytest.approx(1)
    constant = histogram.histogram(df.withColumn("k", F.lit(3.0)), "k", 10).collect()
    assert [(r["bin"], r["density"]) for r in constant] == [(0, None)]


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None), (None, "b")], "x double, s string")
    got = {r["column"]: (r["null_count"], r["null_pct"]) for r in quality.null_profile(df).collect()}
    assert got == {"x": (2, 66.67), "s": (1, 33.33)}


def test_approximate_summary_is_close(spark):
    df = card_events(spark, SMALL)
    exact = {r["is_fraud"]: r["p95"] for r in quality.amount_summary(df).collect()}
    rough = {r["is_fraud"]: r["p95"] for r in quality.amount_summary(df, approx=True).collect()}
    assert all(rough[k] == pytest.approx(exact[k], rel=0.1) for k in exact)
