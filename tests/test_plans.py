"""Physical plans: shuffles, scans and pushed columns of the operators that must scale."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import MEDIUM, SMALL
from txnrisk.operators import asof, assemble, correlation, merchant, profile, quality, rules, sequence, velocity
from txnrisk.operators.account import login_history
from txnrisk.plans import ranked
from txnrisk.plans.hotkeys import run_steps
from txnrisk.plans.running import Running, carried_running
from txnrisk.queries import queries
from txnrisk.queries.inputs import EVENTS_CUTOFF, card_events, login_feed, order_txns, table


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Card events as a table, so that plans show the operator and not the adapter."""
    path = str(tmp_path_factory.mktemp("plans") / "txn")
    card_events(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(df, what):
    return len(re.findall(what, plan(df)))


def test_velocity_is_one_exchange(stored):
    out = velocity.add_velocity(stored).select("trans_num", "TxnCount_1h", "TxnAmount_7d")
    assert count(out, r"Exchange hashpartitioning") == 1 and count(out, r"\bSort \[") == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan(out)).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"trans_num", "cc_num", "unix_time", "amt"}


def test_all_card_features_share_one_exchange(stored):
    out = assemble.card_features(stored, EVENTS_CUTOFF)
    assert count(out, r"Exchange hashpartitioning") == 1 and count(out, "Join") == 0


def test_login_history_adds_no_second_card_exchange(stored, spark):
    out = assemble.card_features(stored, EVENTS_CUTOFF, login_feed(spark, SMALL))
    assert count(out, r"Exchange hashpartitioning") == 1


def test_columns_that_no_window_reads_pass_the_windows_as_one(stored, spark):
    feed = login_feed(spark, SMALL)
    out = asof.past_features(stored, feed)
    assert sum("CarrierType" in line for line in plan(out).splitlines() if "Project" in line) <= 2
    steps = asof.past_steps(login_history())
    whole = run_steps(stored, steps, feeds={"logins": feed})
    assert out.schema == whole.schema and out.exceptAll(whole).isEmpty() and whole.exceptAll(out).isEmpty()
    alone, heavy = asof.past_features(stored), asof.past_features(stored, heavy_rows=20)
    assert alone.columns == run_steps(stored, asof.past_steps()).columns
    assert alone.columns == heavy.columns and alone.exceptAll(heavy).isEmpty()


def test_wide_stages_are_cut_into_methods_that_the_jvm_compiles(spark):
    assert table(spark, SMALL, "events") and int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_rules_read_once(stored):
    out = rules.rule_stats(stored.selectExpr("*", "0.0 AS AmountZScore", "0.0 AS AmountDeviation_30d", "0.0 AS SpendBurstScore",
                                             "0 AS ImpossibleTravelFlag", "0 AS RiskSignalCount"))
    assert count(out, r"FileScan parquet") == 1


@pytest.mark.parametrize("make", [
    lambda df: quality.null_profile(df),
    lambda df: quality.flag_rates(df, ["IsVPN", "IsTor", "IsNewDevice"]),
    lambda df: quality.describe_features(df),
    lambda df: correlation.label_correlation(df, ["amt", "IPRiskScore"]),
    lambda df: assemble.validate_features(df, ["amt", "IsVPN"]),
])
def test_profiles_read_once(stored, make):
    assert count(make(stored), r"FileScan parquet") == 1


def test_statistics_collapse_before_the_shuffle(stored):
    for out in (profile.card_period_stats(stored, EVENTS_CUTOFF), quality.rate_by(stored, "MerchantCategory")):
        text = plan(out)
        assert "partial_" in text and "SinglePartition" not in text.split("Subquery")[0].replace("Exchange SinglePartition, ENSURE", "")


def test_filters_and_columns_reach_the_scan(stored):
    out = stored.where("is_fraud = 1").select("amt")
    assert "PushedFilters: [IsNotNull(is_fraud), EqualTo(is_fraud,1)]" in plan(out)


def test_no_row_table_is_windowed_in_one_partition(spark, monkeypatch):
    """Windows without a partition run over rules or bucket totals only, never over rows."""
    monkeypatch.setattr(ranked, "ROWS_PER_BUCKET", 100)
    allowed = {"rule_ranking", "permutation_importance", "merged_importance"}
    skip = ("stream", "tuning", "trained", "learning", "scored", "holdout", "training", "gain", "zero", "split_imp", "effect")
    for name, fn in queries().items():
        if name in allowed or name.startswith(skip):
            continue
        text = plan(fn(spark, SMALL))
        for block in re.findall(r"\+- Window .*\n(?:.*Sort .*\n)?.*Exchange SinglePartition", text):
            # Carried totals of a whole-table ranking: at most as many rows as buckets.
            assert "_seg" in block, (name, block[:300])


def test_hot_card_is_spread(spark):
    """A card with half of all rows ends up in many tasks, each with a bounded share."""
    df = card_events(spark, SMALL).selectExpr("trans_num", "CASE WHEN trans_num % 2 = 0 THEN 1 ELSE cc_num END AS cc_num", "unix_time", "amt")
    out = velocity.add_velocity(df, heavy_rows=100)
    text = plan(out)
    assert re.search(r"hashpartitioning\(_k0.*_n0.*_seg", text)
    assert "BroadcastHashJoin" in text and "LeftAnti" in text
    assert "heavy-rows" in text and "LeftSemi" not in text  # taken out once, before the plan


def test_row_counts_survive_enrichment(spark):
    txn = order_txns(spark, SMALL)
    feed = table(spark, SMALL, "customer").selectExpr("c_custkey AS cc_num", "c_acctbal AS balance")
    out = assemble.assemble(txn, {"account": (feed, ["cc_num"])}, check=True)
    assert out.count() == txn.count()
    twice = feed.unionByName(feed)
    with pytest.raises(ValueError, match="duplicate keys"):
        assemble.assemble(txn, {"account": (twice, ["cc_num"])}, check=True)


def test_sorted_steps_share_their_order(stored):
    out = sequence.add_travel(velocity.add_velocity(stored))
    assert count(out, r"Exchange hashpartitioning") == 1


def test_carried_rows_are_exchanged_once(spark):
    """With every join by shuffle, the window over the segments needs no second exchange of the rows."""
    df = card_events(spark, SMALL).select("trans_num", "cc_num", "unix_time", "amt")
    specs = {"n": Running("sum", F.lit(1))}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = carried_running(df, ["cc_num"], F.floor(F.col("unix_time") / 3600), [F.col("unix_time"), F.col("trans_num")], specs)
        text = plan(out.select("trans_num", "amt", "n"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    top = text[: text.index("SortMergeJoin")]
    assert "Window" in top and "Exchange" not in top


def test_card_windows_over_a_clustered_table_need_no_exchange(spark):
    from txnrisk.sources.clustered import write_clustered

    df = card_events(spark, SMALL)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    table = write_clustered(df, 4)
    out = assemble.card_features(table, EVENTS_CUTOFF)
    assert count(out, "hashpartitioning\\(cc_num") == 0 and count(out, "Bucketed: true") > 0
    columns = ["trans_num", "TxnAmount_7d", "AmountDeviation_30d", "InterArrivalEntropy", "CategoryDeviationScore", "DistanceFromLastTxn"]
    want = assemble.card_features(df, EVENTS_CUTOFF).select(*columns)
    assert out.select(*columns).orderBy("trans_num").collect() == want.orderBy("trans_num").collect()


def test_distinct_counts_expand_no_row(stored):
    text = plan(profile.card_period_stats(stored, EVENTS_CUTOFF))
    assert "Expand" not in text


def test_a_hot_card_costs_no_more_scans(spark):
    """However many statistics a heavy card needs, the input is read for the ordinary rows, the merchants and the scales only."""
    df = card_events(spark, SMALL).withColumn("cc_num", F.when(F.col("trans_num") % 2 == 0, F.lit(1)).otherwise(F.col("cc_num")))
    plain, hot = (plan(assemble.derive_features(df, EVENTS_CUTOFF, login_feed(spark, SMALL), n)) for n in (10**9, 100))
    scans = [len(re.findall(r"FileScan parquet \[[^\n]*events\.parquet", text)) for text in (plain, hot)]
    assert scans[1] <= scans[0]


def _merchants(spark):
    df = card_events(spark, MEDIUM).repartition(8)
    return df.withColumn("merchant", F.when(F.col("trans_num") % 3 > 0, F.lit("hot")).otherwise(F.col("merchant")))


def test_hot_merchant_is_not_shuffled(spark, monkeypatch):
    """Where merchant statistics are too many to broadcast, rows of a hot merchant still meet them by broadcast."""
    df = _merchants(spark).withColumn("merchant", F.when(F.col("trans_num") % 11 > 0, F.col("merchant")))
    columns = ["trans_num", "MerchantAmountZScore"]
    want = merchant.add_merchant_zscore(df).select(*columns).orderBy("trans_num").collect()
    monkeypatch.setattr(merchant, "MERCHANT_BYTES", 0)
    monkeypatch.setattr(merchant, "JOIN_HEAVY_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = merchant.add_merchant_zscore(df).select(*columns)
        assert out.orderBy("trans_num").collect() == want
        text = plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"SortMergeJoin \[.*merchant", text) and re.search(r"BroadcastHashJoin \[.*merchant#\d+.*_on_merchant.*LeftOuter", text)


def test_hot_feed_key_is_split(spark):
    """A large feed is joined by shuffle; adaptive execution splits the rows of a hot key."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    feed = table(spark, MEDIUM, "customer").selectExpr("concat('m_', c_custkey) AS merchant", "c_acctbal AS balance")
    feed = feed.unionByName(feed.limit(1).withColumn("merchant", F.lit("hot")))
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = assemble.assemble(_merchants(spark).select("trans_num", "merchant"), {"merchant": (feed, ["merchant"])})
        n = len(out.collect())
        text = plan(out)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert n == table(spark, MEDIUM, "events").count() and "skew=true" in text
