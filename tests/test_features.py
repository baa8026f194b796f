"""Features on hand-made rows against plain Python."""

import pytest
from pyspark.sql import functions as F

from tests import sample
from txnrisk.operators import account, merchant, profile, risk, sequence, velocity
from txnrisk.schema import RISK_WEIGHTS


def _by_id(df, *columns):
    return {r["trans_num"]: tuple(r[c] for c in columns) for r in df.collect()}


def _near(got, want):
    return (got is None and want is None) or got == pytest.approx(want, abs=1e-4)


def test_previous_and_travel(spark):
    got = _by_id(sequence.add_travel(sample.frame(spark)), "TimeSinceLastTxnSec", "DistanceFromHome", "DistanceFromLastTxn", "ImpossibleTravelFlag")
    for rows in sample.cards().values():
        for i, r in enumerate(rows):
            prev = rows[i - 1] if i else None
            gap = r[2] - prev[2] if prev else 0
            hop = sample.km(prev[7], prev[8], r[7], r[8]) if prev else None
            home = sample.km(*sample.HOME[r[1]], r[7], r[8])
            flag = int(gap > 0 and (hop or 0) / (gap / 3600) > 500)
            seconds, from_home, from_last, fast = got[r[0]]
            assert seconds == gap and fast == flag
            assert _near(from_home, None if home is None else round(home, 2)) and _near(from_last, round(hop or 0, 2))


def test_velocity_excludes_own_second(spark):
    got = _by_id(velocity.add_velocity(sample.frame(spark)), "TxnCount_1h", "TxnAmount_1h", "TxnCount_7d", "TxnAmount_7d", "AvgTxnAmtLast24h")
    for rows in sample.cards().values():
        for r in rows:
            def window(sec, r=r, rows=rows):
                return [x[3] for x in rows if r[2] - sec <= x[2] < r[2]]

            hour, week, day = window(3600), window(604800), window(86400)
            want = (len(hour), sum(hour), len(week), sum(week), sample.mean(day) if day else 0)
            assert all(_near(a, b) for a, b in zip(got[r[0]], want, strict=True))


def test_amount_deviation_counts_earlier_ties(spark):
    got = _by_id(velocity.add_amount_deviation(sample.frame(spark)), "AmountDeviation_30d")
    for rows in sample.cards().values():
        for i, r in enumerate(rows):
            past = [x[3] for x in rows[:i] if x[2] >= r[2] - 2_592_000]
            want = (r[3] - sample.mean(past)) / (sample.pop_sd(past) or 1) if len(past) >= 2 else 0
            assert _near(got[r[0]][0], want)


def test_card_distributions(spark):
    df = sample.frame(spark)
    hours = _by_id(profile.add_time_of_day_deviation(df), "TimeOfDayDeviation")
    surprise = _by_id(profile.add_category_deviation(df), "CategoryDeviationScore")
    bits = _by_id(profile.add_inter_arrival_entropy(df), "InterArrivalEntropy")
    for rows in sample.cards().values():
        own_hours = [r[6] for r in rows]
        gaps = [b[2] - a[2] for a, b in zip(rows, rows[1:], strict=False)]
        for r in rows:
            assert _near(hours[r[0]][0], (r[6] - sample.mean(own_hours)) / (sample.sample_sd(own_hours) or 1))
            share = sum(x[5] == r[5] for x in rows) / len(rows)
            assert _near(surprise[r[0]][0], 0 if r[5] is None else 1 - share)
            assert _near(bits[r[0]][0], sample.entropy(gaps))


def test_merchant_features(spark):
    got = _by_id(merchant.add_merchant_features(sample.frame(spark)), "MerchantAmountZScore", "SharedMerchantFraudRate")
    for r in sample.ROWS:
        same = [x for x in sample.ROWS if x[4] == r[4]]
        if r[4] is None:
            assert got[r[0]] == (None, None)
            continue
        amounts, labels = [x[3] for x in same], [x[9] for x in same if x[9] is not None]
        z, rate = got[r[0]]
        assert _near(z, (r[3] - sample.mean(amounts)) / (sample.sample_sd(amounts) or 1)) and _near(rate, sample.mean(labels))


def test_period_statistics_ignore_later_rows(spark):
    cutoff = 1_572_000_000
    df = sample.frame(spark)
    changed = df.withColumn("amt", df.amt + (df.unix_time >= cutoff).cast("int") * 1000)
    early = {10, 20, 30, 50}
    a = {r["cc_num"]: r for r in profile.card_period_stats(df, cutoff).collect()}
    b = {r["cc_num"]: r for r in profile.card_period_stats(changed, cutoff).collect()}
    assert all(a[c] == b[c] for c in early)
    late_only = profile.card_period_stats(df.where("cc_num = 30 AND unix_time >= 1575000000"), cutoff).first()
    assert not late_only["in_train_period"] and late_only["max_amt"] == 990.0


def test_visits_and_rank(spark):
    df = sample.frame(spark)
    visits = _by_id(sequence.add_merchant_visits(df), "MerchantVisitRank", "IsFirstAtMerchant")
    assert visits[3] == (2, 0) and visits[1] == (1, 1) and visits[13] == (None, None)
    rank = _by_id(sequence.add_amount_rank(df), "AmountPercentileRank")
    assert rank[4][0] == 1.0 and rank[1][0] == 0.0 and rank[13][0] == 0.0


def test_password_buckets(spark):
    days = [None, 0.0, 1.0, 1.5, 7.0, 30.0, 365.0, 9999.0, 10000.0, -1.0]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "trans_num int, DaysSincePasswordChange double")
    got = _by_id(account.add_password_features(df), "DaysSincePasswordChangeBucket", "NullPwdChange", "HasPasswordChange")
    assert [got[i][0] for i in range(len(days))] == [4, 0, 0, 1, 1, 2, 3, 4, None, None]
    assert got[0][1:] == (1, 0) and got[1][1:] == (0, 1)


def test_login_event_of_the_same_second_is_not_seen(spark):
    txn = spark.createDataFrame([(1, 7, 100), (2, 7, 101), (3, 8, 100)], "trans_num long, cc_num long, unix_time long")
    feed = spark.createDataFrame([(7, 100, 0, 1), (7, 100, 1, 0), (7, 99, 0, 0)], "cc_num long, unix_time long, is_failure int, is_password_change int")
    got = _by_id(account.add_login_features(txn, feed), "LoginAttempts", "LoginFailureRate", "DaysSincePasswordChange")
    assert got[1] == (1, 0.0, None) and got[2] == (2, 0.5, 1 / 86400) and got[3] == (0, 0.0, None)


def test_merchant_join_without_broadcast_is_the_same(spark, monkeypatch):
    df = sample.frame(spark)
    want = merchant.add_merchant_features(df).orderBy("trans_num").collect()
    monkeypatch.setattr(merchant, "MERCHANT_BYTES", 0)
    assert merchant.add_merchant_features(df).orderBy("trans_num").collect() == want


def test_cutoff_ignores_later_labels(spark):
    df = sample.frame(spark)
    flipped = df.withColumn("is_fraud", F.when(F.col("unix_time") >= 1_572_000_000, 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    a = merchant.add_merchant_fraud_rate(df, 1_572_000_000).select("trans_num", "SharedMerchantFraudRate").orderBy("trans_num").collect()
    b = merchant.add_merchant_fraud_rate(flipped, 1_572_000_000).select("trans_num", "SharedMerchantFraudRate").orderBy("trans_num").collect()
    assert a == b


def test_risk_score_scales(spark):
    columns = list(RISK_WEIGHTS)
    rows = [tuple([50.0] * 4 + [0.5] + [50.0] * 3), tuple([None] * 8), tuple([100.0] * 4 + [1.0] + [100.0, 0.0, 100.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "trans_num int, " + ", ".join(f"{c} double" for c in columns))
    scales = risk.fit_risk_scales(df)
    assert scales["BotLikelihoodScore"] == 1.0 and scales["DeviceTrustScore"] == 100.0
    got = _by_id(risk.add_risk_score(df), "RiskSignalWeightedScore")
    assert got == _by_id(risk.add_risk_score(df, scales), "RiskSignalWeightedScore")
    # unknown device trust counts as none, so the inverted signal is full
    assert [got[i][0] for i in range(3)] == [0.5, 0.1, 1.0]
