"""The segmented plan of heavy keys gives the rows of the plain plan."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from txnrisk import session
from txnrisk.operators import account, assemble, profile, sequence, velocity
from txnrisk.plans import hotkeys, joins
from txnrisk.plans.hotkeys import heavy_keys
from txnrisk.queries.inputs import EVENTS_CUTOFF, card_events, login_feed, order_txns


def _hot(spark):
    """Card events with every second row moved to one card, and ties on card and second."""
    df = card_events(spark, SMALL)
    return df.withColumns(
        {
            "cc_num": F.when(F.col("trans_num") % 2 == 0, F.lit(3)).otherwise(F.col("cc_num")),
            "unix_time": F.when(F.col("trans_num") % 5 == 0, F.floor(F.col("unix_time") / 7200) * 7200 - 1).otherwise(F.col("unix_time")),
            "merchant": F.when(F.col("trans_num") % 4 != 0, F.col("merchant")),
            "merch_lat": F.when(F.col("trans_num") % 9 != 0, F.col("merch_lat")),
        }
    )


CASES = {
    "previous_location": lambda df, n: sequence.add_previous_location(df, n),
    "travel": lambda df, n: sequence.add_travel(df, n),
    "geo_speed": lambda df, n: sequence.add_geo_speed_flag(df, heavy_rows=n),
    "merchant_visits": lambda df, n: sequence.add_merchant_visits(df, n),
    "amount_rank": lambda df, n: sequence.add_amount_rank(df, n),
    "prior_amount_rank": lambda df, n: sequence.add_prior_amount_rank(df, n),
    "gaps": lambda df, n: sequence.inter_arrival_gaps(df, n),
    "velocity": lambda df, n: velocity.add_velocity(df, heavy_rows=n),
    "deviation": lambda df, n: velocity.add_amount_deviation(df, heavy_rows=n),
    "zscore": lambda df, n: profile.add_amount_zscore(df, EVENTS_CUTOFF, n).withColumns(
        {c: F.round(c, 6) for c in ("CardAvgAmt", "CardStdAmt")}
    ),
    "time_of_day": lambda df, n: profile.add_time_of_day_deviation(df, n),
    "category": lambda df, n: profile.add_category_deviation(df, n),
    "entropy": lambda df, n: profile.add_inter_arrival_entropy(df, n),
}


def _same(a, b):
    key = ["trans_num"]
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    left = a.select(*columns).orderBy(*key).collect()
    right = b.select(*columns).orderBy(*key).collect()
    assert left == right and left


# One mixed split for every operator; every key heavy for those that carry most state.
RUNS = [(name, 100) for name in CASES] + [(name, 0) for name in ("previous_location", "deviation", "velocity")]


@pytest.mark.parametrize(("name", "limit"), RUNS)
def test_segmented_plan_equals_plain(spark, name, limit):
    df = _hot(spark).select(
        "trans_num", "cc_num", "unix_time", "amt", "merchant", "MerchantCategory", "TransactionHour",
        "cust_lat", "cust_long", "merch_lat", "merch_long",
    )
    _same(CASES[name](df, 10**9), CASES[name](df, limit))


@pytest.mark.parametrize("limit", [100])
def test_login_history_segments(spark, limit):
    df = _hot(spark).select("trans_num", "cc_num", "unix_time")
    logins = login_feed(spark, SMALL).withColumn("cc_num", F.when(F.col("unix_time") % 2 == 0, F.lit(3)).otherwise(F.col("cc_num")))
    _same(account.add_login_features(df, logins, 10**9), account.add_login_features(df, logins, limit))


def test_whole_card_chain_segments(spark):
    df = _hot(spark)
    chained = [assemble.card_features(df, EVENTS_CUTOFF, login_feed(spark, SMALL), n) for n in (10**9, 100)]
    plain, split = [c.drop("CardAvgAmt", "CardStdAmt", "CardMaxAmt") for c in chained]
    _same(plain, split)


def test_null_cards_are_one_key(spark, monkeypatch):
    df = order_txns(spark, SMALL).withColumn("cc_num", F.when(F.col("trans_num") % 3 == 0, F.col("cc_num")))
    df = df.select("trans_num", "cc_num", "unix_time", "amt")
    _same(velocity.add_velocity(df, heavy_rows=10**9), velocity.add_velocity(df, heavy_rows=20))
    df = df.withColumn("MerchantCategory", F.when(F.col("trans_num") % 5 > 0, F.lit("c")))
    _same(profile.add_category_deviation(df, 10**9), profile.add_category_deviation(df, 20))
    monkeypatch.setattr(joins, "SMALL_BYTES", 0)
    _same(profile.add_category_deviation(df, 10**9), profile.add_category_deviation(df, 20))


@pytest.mark.parametrize("operator", [velocity.add_velocity, velocity.add_amount_deviation])
def test_amounts_do_not_depend_on_the_size_of_a_key(spark, operator):
    amounts = [0.00004] * 5 + [0.000012, 0.000023, 0.000034, 0.123456, 19.999999, 19.999999, None, -3.5, 1e9, 1e13, 5e14, 1e15, 7.25, 1e40, float("nan")]
    rows = [(i, card, 1000 + 300 * (i // 3), a) for card in (1, 2) for i, a in enumerate(amounts, card * 100)]
    df = spark.createDataFrame(rows, "trans_num long, cc_num long, unix_time long, amt double").select("trans_num", "cc_num", "unix_time", "amt")
    plain, heavy = (operator(df, heavy_rows=n).drop("amt").na.fill(-99.0) for n in (10**9, 0))  # NaN equals itself
    _same(plain, heavy)


def test_many_rows_of_one_second(spark):
    """Ties of a second are unbounded: the deviation looks at the earlier ones of them, in both shapes."""
    df = spark.range(300).selectExpr("id AS trans_num", "1L AS cc_num", "5000L + id div 100 AS unix_time", "CAST(id % 7 AS DOUBLE) AS amt")
    _same(velocity.add_amount_deviation(df, heavy_rows=10**9), velocity.add_amount_deviation(df, heavy_rows=0))


def test_a_long_heavy_list_is_joined(spark, monkeypatch):
    df = _hot(spark).select("trans_num", "cc_num", "unix_time", "amt")
    monkeypatch.setattr(hotkeys, "BROADCAST_BYTES", 1)
    _same(velocity.add_velocity(df, heavy_rows=10**9), velocity.add_velocity(df, heavy_rows=3))


def test_heavy_list_is_bounded(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("k")).unionByName(spark.range(500).select(F.lit(7).alias("k")))
    assert [r[0] for r in heavy_keys([df], ["k"], 50).collect()] == [7]
    assert heavy_keys([df], ["k"], 1000).isEmpty()


def test_segments_narrow_with_the_fullest_hour(spark, monkeypatch):
    df = _hot(spark).select("trans_num", "cc_num", "unix_time", "amt")
    widths = {}
    for rows in (10**9, 3, 0):
        monkeypatch.setattr(hotkeys, "SEGMENT_ROWS", rows)
        widths[rows] = hotkeys.segment_width([df], ["cc_num"], "unix_time")
        _same(velocity.add_velocity(df, heavy_rows=10**9), velocity.add_velocity(df, heavy_rows=100))
        _same(velocity.add_amount_deviation(df, heavy_rows=10**9), velocity.add_amount_deviation(df, heavy_rows=100))
    assert widths[10**9] == 3600 and widths[0] == 1


def test_shuffles_start_with_partitions_by_rows(spark, monkeypatch):
    df = spark.range(3_000).selectExpr("id AS trans_num", "id % 500 AS cc_num", "5000L + id AS unix_time", "CAST(id % 7 AS DOUBLE) AS amt")
    want = velocity.add_velocity(df).collect()
    before = spark.conf.get(session.INITIAL, None)
    try:
        monkeypatch.setattr(session, "SHUFFLE_ROWS", 100)
        got = velocity.add_velocity(df)
        assert spark.conf.get(session.INITIAL) == "30"
        velocity.add_velocity(df.limit(200))  # a smaller table leaves the number as it is
        assert spark.conf.get(session.INITIAL) == "30"
        assert sorted(got.collect()) == sorted(want)
    finally:
        spark.conf.unset(session.INITIAL)
        if before is not None:
            spark.conf.set(session.INITIAL, before)
