"""Feature queries: sequence, velocity, card profile, merchant, risk, account, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.functions import clip, cut_right_closed, haversine_km, safe_ratio
from txnrisk.operators import account, asof, assemble, merchant, profile, risk, sequence, velocity
from txnrisk.queries.inputs import (
    EVENTS_CUTOFF,
    LOGINS_SQL,
    ORDERS_CUTOFF,
    card_events,
    login_feed,
    order_txns,
    over_events,
    over_orders,
    table,
)
from txnrisk.schema import DERIVED_FEATURES, HORIZONS
from txnrisk.sources.clustered import write_clustered

_KM = (
    "6371.0 * 2 * asin(sqrt(least(greatest(pow(sin((radians({b1}) - radians({a1})) / 2), 2) + cos(radians({a1})) * "
    "cos(radians({b1})) * pow(sin((radians({b2}) - radians({a2})) / 2), 2), 0.0), 1.0)))"
)
_HOME_KM = _KM.format(a1="cust_lat", a2="cust_long", b1="merch_lat", b2="merch_long")
# greatest/least skip nulls, so the hop needs its own null guard.
_HOP_KM = f"CASE WHEN plat IS NOT NULL AND merch_lat IS NOT NULL THEN {_KM.format(a1='plat', a2='plong', b1='merch_lat', b2='merch_long')} END"

_SEQ = "PARTITION BY cc_num ORDER BY unix_time, trans_num"
_PREV = (
    f"prev AS (SELECT *, lag(merch_lat) OVER ({_SEQ}) AS plat, lag(merch_long) OVER ({_SEQ}) AS plong, "
    f"lag(unix_time) OVER ({_SEQ}) AS pt FROM txn), "
    "gap AS (SELECT *, CAST(coalesce(unix_time - pt, 0) AS DOUBLE) AS TimeSinceLastTxnSec FROM prev), "
    f"hop AS (SELECT *, round({_HOME_KM}, 2) AS DistanceFromHome, coalesce(round({_HOP_KM}, 2), 0.0) AS DistanceFromLastTxn FROM gap), "
    "travel AS (SELECT *, CASE WHEN TimeSinceLastTxnSec > 0 AND DistanceFromLastTxn / (TimeSinceLastTxnSec / 3600) > 500 "
    "THEN 1 ELSE 0 END AS ImpossibleTravelFlag FROM hop)"
)


def _velocity_sql(source: str) -> str:
    cols = []
    for name, seconds in HORIZONS.items():
        frame = f"OVER (PARTITION BY cc_num ORDER BY unix_time RANGE BETWEEN {seconds} PRECEDING AND 1 PRECEDING)"
        cols.append(f"count(*) {frame} AS TxnCount_{name}")
        cols.append(f"round(coalesce(sum(amt) {frame}, 0.0), 4) AS TxnAmount_{name}")
    return (
        f"vel0 AS (SELECT *, {', '.join(cols)} FROM {source}), "
        "vel AS (SELECT *, round(CASE WHEN TxnCount_24h > 0 THEN TxnAmount_24h / TxnCount_24h ELSE 0 END, 4) AS AvgTxnAmtLast24h FROM vel0)"
    )


_BURST = (
    "burst AS (SELECT *, round(CASE WHEN TxnAmount_7d = 0 THEN 0 ELSE least(greatest(TxnAmount_1h / (TxnAmount_7d / 168), 0), 100) END, 4) "
    "AS SpendBurstScore, round(CASE WHEN TxnCount_24h = 0 THEN 0 ELSE least(greatest(TxnCount_1h / (TxnCount_24h / 24), 0), 100) END, 4) "
    "AS VelocityAcceleration FROM vel)"
)

# Earlier rows of the card, not older than 30 days, spelled as a self-join.
_DEVIATION_JOIN = (
    "dev AS (SELECT a.trans_num, CASE WHEN count(b.amt) >= 2 THEN round((any_value(a.amt) - avg(b.amt)) / "
    "coalesce(nullif(stddev_pop(b.amt), 0), 1), 4) + 0.0 ELSE 0.0 END AS AmountDeviation_30d "
    "FROM {source} a LEFT JOIN {source} b ON a.cc_num = b.cc_num AND b.unix_time >= a.unix_time - 2592000 "
    "AND (b.unix_time < a.unix_time OR (b.unix_time = a.unix_time AND b.trans_num < a.trans_num)) GROUP BY a.trans_num)"
)


def _period(source: str, cutoff: int) -> str:
    return (
        f"card AS (SELECT cc_num, bool_or(unix_time < {cutoff}) AS in_train_period, "
        + ", ".join(
            f"CASE WHEN bool_or(unix_time < {cutoff}) THEN {agg} FILTER (WHERE unix_time < {cutoff}) ELSE {agg} END AS {name}"
            for name, agg in {
                "avg_amt": "avg(amt)",
                "std_amt": "stddev_samp(amt)",
                "max_amt": "max(amt)",
                "merchant_diversity": "count(DISTINCT merchant)",
                "category_diversity": "count(DISTINCT MerchantCategory)",
            }.items()
        )
        + f" FROM {source} GROUP BY cc_num)"
    )


def _entropy(source: str = "txn") -> str:
    return (
        f"gaps AS (SELECT cc_num, unix_time - lag(unix_time) OVER ({_SEQ}) AS g FROM {source}), "
        "ends AS (SELECT cc_num, count(g) AS n, min(g) AS lo, max(g) AS hi FROM gaps GROUP BY cc_num), "
        "bins AS (SELECT cc_num, n, CASE WHEN hi = lo THEN 0 ELSE least(floor((g - lo) / (hi - lo) * least(20, n)), least(20, n) - 1) END AS bin, "
        "count(*) AS c FROM gaps JOIN ends USING (cc_num) WHERE g IS NOT NULL GROUP BY ALL), "
        "ent AS (SELECT cc_num, round(-sum(c / n * log2(c / n)), 4) + 0.0 AS e, any_value(n) AS n FROM bins GROUP BY cc_num)"
    )


def _merchant(source: str = "txn") -> str:
    return (
        "merch AS (SELECT merchant, avg(amt) AS ma, coalesce(nullif(stddev_samp(amt), 0), 1) AS ms, "
        f"sum(is_fraud) / count(is_fraud) AS mr FROM {source} GROUP BY merchant)"
    )


_ENTROPY, _MERCHANT = _entropy(), _merchant()

_SCORES = {
    "IPRiskScore": (0.20, 100),
    "EmailRiskScore": (0.15, 100),
    "PhoneRiskScore": (0.10, 100),
    "AddressRiskScore": (0.10, 100),
    "BotLikelihoodScore": (0.20, 1),
    "MerchantRiskScore": (0.10, 100),
    "HistoricalVelocityScore": (0.05, 100),
}
_RISK = " + ".join(
    [f"{w} * coalesce({c}, 0) / {s}" for c, (w, s) in _SCORES.items()] + ["0.10 * (100 - coalesce(DeviceTrustScore, 0)) / 100"]
)

_LOGIN = (
    "mixed AS (SELECT cc_num, unix_time, 0 AS kind, trans_num, 0 AS att, 0 AS fail, NULL AS ch FROM txn UNION ALL "
    "SELECT cc_num, unix_time, 1, NULL, 1 - is_password_change, is_failure, "
    "CASE WHEN is_password_change = 1 THEN unix_time END FROM logins), "
    "ran AS (SELECT trans_num, unix_time, kind, sum(att) OVER w AS att, sum(fail) OVER w AS fail, max(ch) OVER w AS ch FROM mixed "
    "WINDOW w AS (PARTITION BY cc_num ORDER BY unix_time, kind ROWS UNBOUNDED PRECEDING)), "
    "login AS (SELECT trans_num, CAST(att AS BIGINT) AS LoginAttempts, round(CASE WHEN att > 0 THEN fail / att ELSE 0 END, 4) "
    "AS LoginFailureRate, (unix_time - ch) / 86400 AS DaysSincePasswordChange FROM ran WHERE kind = 0)"
)

_BUCKET = (
    "CASE WHEN coalesce({d}, 9999) <= -1 THEN NULL WHEN coalesce({d}, 9999) <= 1 THEN 0 WHEN {d} <= 7 THEN 1 WHEN {d} <= 30 THEN 2 "
    "WHEN {d} <= 365 THEN 3 WHEN coalesce({d}, 9999) <= 9999 THEN 4 END"
)
_PASSWORD = (
    "CASE WHEN DaysSincePasswordChange IS NULL THEN 1 ELSE 0 END AS NullPwdChange, "
    "CASE WHEN DaysSincePasswordChange IS NULL THEN 0 ELSE 1 END AS HasPasswordChange, "
    f"{_BUCKET.format(d='DaysSincePasswordChange')} AS DaysSincePasswordChangeBucket"
)

_FLAGS = {
    "Rule_HighVelocity": "TxnCount_1h >= 3",
    "Rule_CountryMismatch": "IPCountryMismatch = 1",
    "Rule_NewDeviceHighAmount": "IsNewDevice = 1 AND AmountZScore >= 2",
    "Rule_DisposableEmail": "IsDisposableEmail = 1",
    "Rule_VPNorTor": "IsVPN = 1 OR IsTor = 1",
    "Rule_BotLikely": "BotLikelihoodScore >= 0.7",
    "Rule_ImpossibleTravel": "ImpossibleTravelFlag = 1",
    "Rule_SyntheticIdentity": "SyntheticIdentityFlag = 1",
    "Rule_NewAccount": "AccountAgeDays <= 30",
    "Rule_SharedDevice": "NumAccountsOnDevice > 3",
}

def _wide_sql(card: str, profiled: str, join: str) -> str:
    """The wide table over the card events: every derived column, with profiles of the rows of ``profiled``."""
    return ", ".join(
        [
            LOGINS_SQL,
            _PREV,
            _velocity_sql("travel"),
            _BURST,
            _DEVIATION_JOIN.format(source="txn"),
            card,
            _entropy(profiled),
            _merchant(profiled),
            _LOGIN,
            "hourly AS (SELECT cc_num, avg(TransactionHour) AS hm, coalesce(nullif(stddev_samp(TransactionHour), 0), 1) AS hs, count(*) AS cn "
            f"FROM {profiled} GROUP BY cc_num)",
            f"pair AS (SELECT cc_num, MerchantCategory, count(*) AS pn FROM {profiled} GROUP BY 1, 2)",
            "feat0 AS (SELECT b.*, AmountDeviation_30d, LoginAttempts, LoginFailureRate, DaysSincePasswordChange, "
            "round((b.amt - avg_amt) / coalesce(nullif(std_amt, 0), 1), 4) + 0.0 AS AmountZScore, "
            "round((TransactionHour - hm) / hs, 4) + 0.0 AS TimeOfDayDeviation, "
            "CASE WHEN b.MerchantCategory IS NULL THEN 0.0 ELSE round(1 - coalesce(pn, 0) / coalesce(cn, 1), 4) END AS CategoryDeviationScore, "
            "CASE WHEN ent.n >= 2 THEN e ELSE 0.0 END AS InterArrivalEntropy, "
            "round((b.amt - ma) / ms, 4) + 0.0 AS MerchantAmountZScore, mr AS SharedMerchantFraudRate, "
            f"round({_RISK}, 4) AS RiskSignalWeightedScore "
            f"FROM burst b JOIN dev USING (trans_num) JOIN login USING (trans_num) {join} card USING (cc_num) {join} hourly USING (cc_num) "
            "LEFT JOIN ent USING (cc_num) LEFT JOIN merch USING (merchant) "
            "LEFT JOIN pair ON b.cc_num = pair.cc_num AND b.MerchantCategory = pair.MerchantCategory)",
            f"feat AS (SELECT *, {_PASSWORD}, CAST(coalesce(NumAccountsOnDevice, 1) AS INT) AS DeviceClusterSize, "
            "CAST(coalesce(NumAccountsOnDevice > 3 AND PreviousFraudFlag = 1, false) AS INT) AS LinkedFraudAccounts, "
            "ln(1 + amt) AS log_amt, ln(1 + DistanceFromHome) AS log_DistanceFromHome, ln(1 + TimeSinceLastTxnSec) AS log_TimeSinceLastTxn, "
            "ln(1 + TxnAmount_7d) AS log_TxnAmount_7d, round(IsNewDevice * IPRiskScore, 4) AS IsNewDevice_x_IPRisk, "
            "round(IsVPN * abs(AmountZScore), 4) AS IsVPN_x_AmtZScore, round(BotLikelihoodScore * TxnCount_1h, 4) AS Bot_x_Velocity FROM feat0)",
            "flags AS (SELECT *, " + ", ".join(f"CAST(coalesce({p}, false) AS INT) AS {n}" for n, p in _FLAGS.items()) + " FROM feat)",
            f"wide AS (SELECT *, {' + '.join(_FLAGS)} AS RiskSignalCount FROM flags)",
        ]
    )


# Statistics of the whole table but for the cards' amounts; and statistics of the train period throughout.
WIDE_SQL = _wide_sql(_period("txn", EVENTS_CUTOFF), "txn", "JOIN")
WIDE_ASOF_SQL = f"early AS (SELECT * FROM txn WHERE unix_time < {EVENTS_CUTOFF}), " + _wide_sql(
    "card AS (SELECT cc_num, avg(amt) AS avg_amt, stddev_samp(amt) AS std_amt FROM early GROUP BY cc_num)", "early", "LEFT JOIN"
)


def wide_events(spark, sf_dir):
    """Card events with login features, all derived features and rule flags."""
    return risk.add_rule_flags(assemble.derive_features(card_events(spark, sf_dir), EVENTS_CUTOFF, login_feed(spark, sf_dir)))


def asof_profiles(spark, sf_dir):
    events = card_events(spark, sf_dir)
    return asof.fit_profiles(events.where(F.col("unix_time") < EVENTS_CUTOFF))


def asof_events(spark, sf_dir):
    """Card events with the features they have when they are scored."""
    return asof.derive_asof(card_events(spark, sf_dir), asof_profiles(spark, sf_dir), login_feed(spark, sf_dir))


def _rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


LOGS = ["log_amt", "log_DistanceFromHome", "log_TimeSinceLastTxn", "log_TxnAmount_7d"]


def feature_table(df):
    return _rounded(assemble.feature_table(df), [*LOGS, "SharedMerchantFraudRate"])


def feature_table_sql(wide=WIDE_SQL):
    cols = [f"round({c}, 6) AS {c}" if c in LOGS or c == "SharedMerchantFraudRate" else c for c in DERIVED_FEATURES]
    return over_events(f"SELECT trans_num, {', '.join(cols)}, is_fraud FROM wide", wide)


VELOCITY = [f"Txn{kind}_{h}" for h in HORIZONS for kind in ("Count", "Amount")] + ["AvgTxnAmtLast24h"]
# Every derived feature, the other engineered columns and the rule flags.
VALIDATED = [*DERIVED_FEATURES, "amt", *VELOCITY, "TimeSinceLastTxnSec", "AmountZScore", "LoginAttempts", "LoginFailureRate", *_FLAGS, "RiskSignalCount"]


def _validate(spark, sf_dir):
    out = assemble.validate_features(wide_events(spark, sf_dir), VALIDATED)
    return _rounded(out, ["legit_avg", "fraud_avg"], 4)


def _validate_sql():
    parts = [
        f"SELECT '{c}' AS feature, round(avg({c}) FILTER (WHERE is_fraud = 0), 4) AS legit_avg, "
        f"round(avg({c}) FILTER (WHERE is_fraud = 1), 4) AS fraud_avg FROM wide"
        for c in VALIDATED
    ]
    return over_events(" UNION ALL ".join(parts), WIDE_SQL.replace("wide AS (", "wide AS MATERIALIZED ("))


# The ten named feeds: name -> (source table, key of the orders, key of the table, column of the table, new column).
# Feeds that the driver has no table of their own for are readings of its customer, supplier, nation, part and order tables.
FEEDS = {
    "identity": ("customer", "cc_num", "c_custkey", "c_name", "identity"),
    "email": ("customer", "cc_num", "c_custkey", "lower(c_name) || '@example.com'", "email"),
    "phone": ("customer", "cc_num", "c_custkey", "'+' || CAST(1000000000 + c_custkey AS STRING)", "phone"),
    "ip": ("nation", "nation", "n_nationkey", "'10.0.0.' || CAST(n_nationkey AS STRING)", "ip_block"),
    "address": ("nation", "nation", "n_nationkey", "n_name", "country"),
    "bureau": ("customer", "cc_num", "c_custkey", "CAST(c_acctbal * 2 AS DOUBLE)", "bureau_score"),
    "device": ("orders", "trans_num", "o_orderkey", "'dev_' || CAST(o_orderkey % 911 AS STRING)", "device"),
    "merchant": ("supplier", "merchant", "s_suppkey", "s_acctbal", "merchant_balance"),
    "account": ("customer", "cc_num", "c_custkey", "c_acctbal", "account_balance"),
    "login": ("customer", "cc_num", "c_custkey", "c_custkey % 30", "login_days"),
}


def _enrich(spark, sf_dir):
    """Orders joined to all ten feeds."""
    txn = order_txns(spark, sf_dir).select("trans_num", "cc_num", "merchant", "nation")
    feeds = {name: (table(spark, sf_dir, source).selectExpr(f"{own} AS {key}", f"{value} AS {new}"), [key]) for name, (source, key, own, value, new) in FEEDS.items()}
    return assemble.assemble(txn, feeds, check=True).select("trans_num", "cc_num", "merchant", *[new for *_, new in FEEDS.values()])


def _enrich_sql():
    joins = " ".join(
        f"LEFT JOIN (SELECT {own} AS k_{name}, {value.replace('AS STRING', 'AS VARCHAR')} AS {new} FROM {source}) f_{name} ON txn.{key} = k_{name}"
        for name, (source, key, own, value, new) in FEEDS.items()
    )
    return over_orders(f"SELECT trans_num, cc_num, merchant, {', '.join(new for *_, new in FEEDS.values())} FROM txn {joins}")


def _asof(spark, sf_dir):
    feed = login_feed(spark, sf_dir)
    txn = card_events(spark, sf_dir).select("trans_num", "cc_num", "unix_time")
    return account.asof_latest(txn, feed.where("is_password_change = 1"), "cc_num", "unix_time", "changed_at")


def _select(fn, *columns):
    return lambda spark, sf_dir: fn(spark, sf_dir).select(*columns)


TRAVEL = ["trans_num", "DistanceFromHome", "DistanceFromLastTxn", "ImpossibleTravelFlag"]


def _risk_inputs(spark, sf_dir):
    return risk.add_risk_score(card_events(spark, sf_dir))


def _ratio_row(df):
    return df.select(
        "trans_num",
        F.round(safe_ratio("amt", F.col("ChargebackCount")), 4).alias("amt_per_chargeback"),
        clip("amt", 10.0, 100.0).alias("amt_clipped"),
        clip("EmailRiskScore", 20.0, 80.0).alias("email_clipped"),
        F.coalesce("EmailRiskScore", F.lit(0.0)).alias("email_filled"),
        cut_right_closed("IPRiskScore", [0, 25, 50, 100], ["low", "mid", "high"]).alias("ip_band"),
        F.round(haversine_km("cust_lat", "cust_long", "merch_lat", "merch_long"), 2).alias("home_km"),
        F.expr("try_cast(IF(trans_num % 3 = 0, 'n/a', CAST(amt AS STRING)) AS DOUBLE)").alias("amt_parsed"),
    )


QUERIES = {
    "scalar_functions": lambda s, d: _ratio_row(card_events(s, d)),
    "calendar_parts": lambda s, d: profile.add_calendar(order_txns(s, d)).select(
        "trans_num", "TransactionHour", "DayOfWeek", "IsWeekend", "IsNightTxn"
    ),
    "calendar_parts_events": lambda s, d: profile.add_calendar(
        card_events(s, d).drop("TransactionHour", "DayOfWeek", "IsWeekend", "IsNightTxn")
    ).select("trans_num", "TransactionHour", "DayOfWeek", "IsWeekend", "IsNightTxn"),
    "previous_location": lambda s, d: sequence.add_previous_location(card_events(s, d)).select(
        "trans_num", "prev_merch_lat", "prev_merch_long", "prev_unix_time"
    ),
    "time_since_last": lambda s, d: sequence.add_time_since_last(card_events(s, d)).select("trans_num", "TimeSinceLastTxnSec"),
    "travel_features": lambda s, d: sequence.add_travel(card_events(s, d)).select(*TRAVEL),
    "geo_speed_flag": lambda s, d: sequence.add_geo_speed_flag(card_events(s, d), 1000.0, 7200.0).select(
        "trans_num", "SuspiciousGeoSpeedFlag"
    ),
    "merchant_visits": lambda s, d: sequence.add_merchant_visits(order_txns(s, d)).select(
        "trans_num", "MerchantVisitRank", "IsFirstAtMerchant"
    ),
    "amount_percentile_rank": lambda s, d: _rounded(
        sequence.add_amount_rank(card_events(s, d)).select("trans_num", "AmountPercentileRank"), ["AmountPercentileRank"]
    ),
    "amount_percentile_rank_prior": lambda s, d: _rounded(
        sequence.add_prior_amount_rank(card_events(s, d)).select("trans_num", "PriorAmountPercentileRank"), ["PriorAmountPercentileRank"]
    ),
    "inter_arrival_gaps": lambda s, d: sequence.inter_arrival_gaps(card_events(s, d)),
    "velocity": lambda s, d: velocity.add_velocity(card_events(s, d)).select("trans_num", *VELOCITY),
    "clustered_velocity": lambda s, d: velocity.add_velocity(
        write_clustered(card_events(s, d).select("trans_num", "cc_num", "unix_time", "amt"), 8)
    ).select("trans_num", *VELOCITY),
    "amount_deviation_30d": lambda s, d: velocity.add_amount_deviation(card_events(s, d)).select("trans_num", "AmountDeviation_30d"),
    "amount_deviation_ties": lambda s, d: velocity.add_amount_deviation(order_txns(s, d)).select("trans_num", "AmountDeviation_30d"),
    "burst_ratios": lambda s, d: velocity.add_burst_ratios(velocity.add_velocity(card_events(s, d))).select(
        "trans_num", "SpendBurstScore", "VelocityAcceleration"
    ),
    "card_period_stats": lambda s, d: _rounded(
        profile.card_period_stats(order_txns(s, d), ORDERS_CUTOFF), ["avg_amt", "std_amt"], 6
    ).withColumn("in_train_period", F.col("in_train_period").cast("int")),
    "amount_zscore": lambda s, d: profile.add_amount_zscore(order_txns(s, d), ORDERS_CUTOFF).select("trans_num", "AmountZScore"),
    "time_of_day_deviation": lambda s, d: profile.add_time_of_day_deviation(card_events(s, d)).select("trans_num", "TimeOfDayDeviation"),
    "category_deviation": lambda s, d: profile.add_category_deviation(card_events(s, d)).select("trans_num", "CategoryDeviationScore"),
    "time_of_day_deviation_train_period": lambda s, d: profile.add_time_of_day_deviation(card_events(s, d), cutoff=EVENTS_CUTOFF).select(
        "trans_num", "TimeOfDayDeviation"
    ),
    "category_deviation_train_period": lambda s, d: profile.add_category_deviation(card_events(s, d), cutoff=EVENTS_CUTOFF).select(
        "trans_num", "CategoryDeviationScore"
    ),
    "merchant_zscore_train_period": lambda s, d: merchant.add_merchant_zscore(order_txns(s, d), ORDERS_CUTOFF).select(
        "trans_num", "MerchantAmountZScore"
    ),
    "category_fractions": lambda s, d: _rounded(profile.category_fractions(card_events(s, d)), ["frac"]),
    "inter_arrival_entropy": lambda s, d: profile.add_inter_arrival_entropy(card_events(s, d)).select("trans_num", "InterArrivalEntropy"),
    "merchant_zscore": lambda s, d: merchant.add_merchant_zscore(order_txns(s, d)).select("trans_num", "MerchantAmountZScore"),
    "merchant_fraud_rate": lambda s, d: _rounded(
        merchant.add_merchant_fraud_rate(order_txns(s, d)).select("trans_num", "SharedMerchantFraudRate"), ["SharedMerchantFraudRate"]
    ),
    "merchant_rates_by_period": lambda s, d: _rounded(
        merchant.merchant_fraud_rates(order_txns(s, d), ORDERS_CUTOFF), ["train_fraud_rate", "all_fraud_rate"]
    ),
    "risk_score": _select(_risk_inputs, "trans_num", "RiskSignalWeightedScore"),
    "device_features": lambda s, d: risk.add_device_features(card_events(s, d)).select(
        "trans_num", "DeviceClusterSize", "LinkedFraudAccounts"
    ),
    "asof_password_change": _asof,
    "login_features": lambda s, d: _rounded(
        account.add_login_features(card_events(s, d), login_feed(s, d)).select(
            "trans_num", "LoginAttempts", "LoginFailureRate", "DaysSincePasswordChange"
        ),
        ["DaysSincePasswordChange"],
        8,
    ),
    "password_features": lambda s, d: account.add_password_features(
        account.add_login_features(card_events(s, d), login_feed(s, d))
    ).select("trans_num", "NullPwdChange", "HasPasswordChange", "DaysSincePasswordChangeBucket"),
    "logs_and_interactions": lambda s, d: _rounded(
        wide_events(s, d).select("trans_num", *LOGS, "IsNewDevice_x_IPRisk", "IsVPN_x_AmtZScore", "Bot_x_Velocity"), LOGS
    ),
    "rule_flags": _select(wide_events, "trans_num", *_FLAGS, "RiskSignalCount"),
    "feature_table": lambda s, d: feature_table(wide_events(s, d)),
    "feature_table_asof": lambda s, d: feature_table(asof_events(s, d)),
    "feature_validation": _validate,
    "enrichment": _enrich,
    "merchant_lookup": lambda s, d: assemble.enrich_codes(
        order_txns(s, d), table(s, d, "supplier"), "merchant", "s_suppkey", "s_name", "merchant_name"
    ).select("trans_num", "merchant_name"),
    "global_statistics": lambda s, d: assemble.with_global(
        card_events(s, d).select("trans_num", "amt"), {"max_amt": F.max("amt"), "rows": F.count(F.lit(1))}
    ),
}

_CALENDAR_SQL = (
    "SELECT trans_num, CAST(hour(make_timestamp(unix_time * 1000000)) AS INT) AS TransactionHour, "
    "CAST(dayofweek(make_timestamp(unix_time * 1000000)) + 1 AS INT) AS DayOfWeek, "
    "CAST(dayofweek(make_timestamp(unix_time * 1000000)) IN (0, 6) AS INT) AS IsWeekend, "
    "CAST(hour(make_timestamp(unix_time * 1000000)) <= 5 AS INT) AS IsNightTxn FROM txn"
)

ORACLE = {
    "scalar_functions": over_events(
        "SELECT trans_num, round(CASE WHEN ChargebackCount = 0 THEN 0 ELSE amt / ChargebackCount END, 4) AS amt_per_chargeback, "
        "least(greatest(amt, 10.0), 100.0) AS amt_clipped, "
        "CASE WHEN EmailRiskScore IS NOT NULL THEN least(greatest(EmailRiskScore, 20.0), 80.0) END AS email_clipped, "
        "coalesce(EmailRiskScore, 0.0) AS email_filled, CASE WHEN IPRiskScore <= 0 THEN NULL WHEN IPRiskScore <= 25 THEN 'low' "
        "WHEN IPRiskScore <= 50 THEN 'mid' WHEN IPRiskScore <= 100 THEN 'high' END AS ip_band, "
        f"round({_HOME_KM}, 2) AS home_km, CASE WHEN trans_num % 3 <> 0 THEN amt END AS amt_parsed FROM txn"
    ),
    "calendar_parts": over_orders(_CALENDAR_SQL),
    "calendar_parts_events": over_events(_CALENDAR_SQL),
    "previous_location": over_events(
        "SELECT trans_num, plat AS prev_merch_lat, plong AS prev_merch_long, pt AS prev_unix_time FROM prev", _PREV
    ),
    "time_since_last": over_events("SELECT trans_num, TimeSinceLastTxnSec FROM gap", _PREV),
    "travel_features": over_events(f"SELECT {', '.join(TRAVEL)} FROM travel", _PREV),
    "geo_speed_flag": over_events(
        "SELECT trans_num, CAST(DistanceFromLastTxn >= 1000 AND pt IS NOT NULL AND TimeSinceLastTxnSec <= 7200 AS INT) "
        "AS SuspiciousGeoSpeedFlag FROM travel",
        _PREV,
    ),
    "merchant_visits": over_orders(
        "SELECT trans_num, CASE WHEN merchant IS NOT NULL THEN r END AS MerchantVisitRank, "
        "CASE WHEN merchant IS NOT NULL THEN CAST(r = 1 AS INT) END AS IsFirstAtMerchant FROM "
        "(SELECT *, row_number() OVER (PARTITION BY cc_num, merchant ORDER BY unix_time, trans_num) AS r FROM txn)"
    ),
    "amount_percentile_rank": over_events(
        "SELECT trans_num, round(percent_rank() OVER (PARTITION BY cc_num ORDER BY amt), 6) AS AmountPercentileRank FROM txn"
    ),
    "amount_percentile_rank_prior": over_events(
        "SELECT a.trans_num, CASE WHEN any_value(a.amt) IS NULL THEN NULL WHEN count(b.amt) = 0 THEN 0.0 "
        "ELSE round(count(*) FILTER (b.amt < a.amt) / count(b.amt), 6) END AS PriorAmountPercentileRank "
        "FROM txn a LEFT JOIN txn b ON a.cc_num = b.cc_num AND (b.unix_time < a.unix_time OR (b.unix_time = a.unix_time AND b.trans_num < a.trans_num)) "
        "GROUP BY a.trans_num"
    ),
    "inter_arrival_gaps": over_events(
        "SELECT cc_num, trans_num, unix_time - pt AS gap_sec FROM prev WHERE pt IS NOT NULL", _PREV
    ),
    "clustered_velocity": over_events(f"SELECT trans_num, {', '.join(VELOCITY)} FROM vel", _velocity_sql("txn")),
    "velocity": over_events(f"SELECT trans_num, {', '.join(VELOCITY)} FROM vel", _velocity_sql("txn")),
    "amount_deviation_30d": over_events("SELECT trans_num, AmountDeviation_30d FROM dev", _DEVIATION_JOIN.format(source="txn")),
    "amount_deviation_ties": over_orders("SELECT trans_num, AmountDeviation_30d FROM dev", _DEVIATION_JOIN.format(source="txn")),
    "burst_ratios": over_events(
        "SELECT trans_num, SpendBurstScore, VelocityAcceleration FROM burst", _velocity_sql("txn") + ", " + _BURST
    ),
    "card_period_stats": over_orders(
        "SELECT cc_num, CAST(in_train_period AS INT) AS in_train_period, round(avg_amt, 6) AS avg_amt, round(std_amt, 6) AS std_amt, "
        "max_amt, merchant_diversity, category_diversity FROM card",
        _period("txn", ORDERS_CUTOFF),
    ),
    "amount_zscore": over_orders(
        "SELECT trans_num, round((amt - avg_amt) / coalesce(nullif(std_amt, 0), 1), 4) + 0.0 AS AmountZScore FROM txn JOIN card USING (cc_num)",
        _period("txn", ORDERS_CUTOFF),
    ),
    "time_of_day_deviation": over_events(
        "SELECT trans_num, round((TransactionHour - avg(TransactionHour) OVER w) / coalesce(nullif(stddev_samp(TransactionHour) OVER w, 0), 1), 4) "
        "+ 0.0 AS TimeOfDayDeviation FROM txn WINDOW w AS (PARTITION BY cc_num)"
    ),
    "category_deviation": over_events(
        "SELECT trans_num, CASE WHEN MerchantCategory IS NULL THEN 0.0 ELSE round(1 - count(*) OVER (PARTITION BY cc_num, MerchantCategory) / "
        "count(*) OVER (PARTITION BY cc_num), 4) END AS CategoryDeviationScore FROM txn"
    ),
    "time_of_day_deviation_train_period": over_events(
        "SELECT trans_num, round((TransactionHour - avg(h) OVER w) / coalesce(nullif(stddev_samp(h) OVER w, 0), 1), 4) + 0.0 AS TimeOfDayDeviation "
        f"FROM (SELECT *, CASE WHEN unix_time < {EVENTS_CUTOFF} THEN TransactionHour END AS h FROM txn) WINDOW w AS (PARTITION BY cc_num)"
    ),
    "category_deviation_train_period": over_events(
        "SELECT trans_num, CASE WHEN MerchantCategory IS NULL THEN 0.0 WHEN cn = 0 THEN 1.0 ELSE round(1 - pn / cn, 4) END AS CategoryDeviationScore "
        f"FROM (SELECT *, count(*) FILTER (WHERE unix_time < {EVENTS_CUTOFF}) OVER (PARTITION BY cc_num, MerchantCategory) AS pn, "
        f"count(*) FILTER (WHERE unix_time < {EVENTS_CUTOFF}) OVER (PARTITION BY cc_num) AS cn FROM txn)"
    ),
    "merchant_zscore_train_period": over_orders(
        "SELECT trans_num, round((amt - ma) / ms, 4) + 0.0 AS MerchantAmountZScore FROM txn LEFT JOIN merch USING (merchant)",
        _MERCHANT.replace("FROM txn", f"FROM txn WHERE unix_time < {ORDERS_CUTOFF}"),
    ),
    "category_fractions": over_events(
        "SELECT * FROM (SELECT cc_num, MerchantCategory, round(count(*) / any_value(n), 6) AS frac FROM txn "
        "JOIN (SELECT cc_num, count(*) AS n FROM txn GROUP BY cc_num) USING (cc_num) GROUP BY 1, 2) WHERE MerchantCategory IS NOT NULL"
    ),
    "inter_arrival_entropy": over_events(
        "SELECT trans_num, CASE WHEN n >= 2 THEN e ELSE 0.0 END AS InterArrivalEntropy FROM txn LEFT JOIN ent USING (cc_num)", _ENTROPY
    ),
    "merchant_zscore": over_orders(
        "SELECT trans_num, round((amt - ma) / ms, 4) + 0.0 AS MerchantAmountZScore FROM txn LEFT JOIN merch USING (merchant)", _MERCHANT
    ),
    "merchant_fraud_rate": over_orders(
        "SELECT trans_num, round(mr, 6) AS SharedMerchantFraudRate FROM txn LEFT JOIN merch USING (merchant)", _MERCHANT
    ),
    "merchant_rates_by_period": over_orders(
        f"SELECT merchant, count(is_fraud) FILTER (WHERE unix_time < {ORDERS_CUTOFF}) AS train_txns, "
        f"round(avg(is_fraud) FILTER (WHERE unix_time < {ORDERS_CUTOFF}), 6) AS train_fraud_rate, count(is_fraud) AS all_txns, "
        "round(avg(is_fraud), 6) AS all_fraud_rate FROM txn WHERE merchant IS NOT NULL GROUP BY merchant"
    ),
    "risk_score": over_events(f"SELECT trans_num, round({_RISK}, 4) AS RiskSignalWeightedScore FROM txn"),
    "device_features": over_events(
        "SELECT trans_num, CAST(coalesce(NumAccountsOnDevice, 1) AS INT) AS DeviceClusterSize, "
        "CAST(NumAccountsOnDevice > 3 AND PreviousFraudFlag = 1 AS INT) AS LinkedFraudAccounts FROM txn"
    ),
    "asof_password_change": over_events(
        "SELECT trans_num, t.cc_num, t.unix_time, c.unix_time AS changed_at FROM txn t ASOF LEFT JOIN "
        "(SELECT DISTINCT cc_num, unix_time FROM logins WHERE is_password_change = 1) c ON t.cc_num = c.cc_num AND t.unix_time > c.unix_time",
        LOGINS_SQL,
    ),
    "login_features": over_events(
        "SELECT trans_num, LoginAttempts, LoginFailureRate, round(DaysSincePasswordChange, 8) AS DaysSincePasswordChange FROM login",
        LOGINS_SQL + ", " + _LOGIN,
    ),
    "password_features": over_events(f"SELECT trans_num, {_PASSWORD} FROM login", LOGINS_SQL + ", " + _LOGIN),
    "logs_and_interactions": over_events(
        f"SELECT trans_num, {', '.join(f'round({c}, 6) AS {c}' for c in LOGS)}, IsNewDevice_x_IPRisk, IsVPN_x_AmtZScore, Bot_x_Velocity FROM wide",
        WIDE_SQL,
    ),
    "rule_flags": over_events(f"SELECT trans_num, {', '.join(_FLAGS)}, RiskSignalCount FROM wide", WIDE_SQL),
    "feature_table": feature_table_sql(),
    "feature_table_asof": feature_table_sql(WIDE_ASOF_SQL),
    "feature_validation": _validate_sql(),
    "enrichment": _enrich_sql(),
    "merchant_lookup": over_orders(
        "SELECT trans_num, s_name AS merchant_name FROM txn LEFT JOIN supplier ON merchant = s_suppkey"
    ),
    "global_statistics": over_events(
        "SELECT trans_num, amt, max(amt) OVER () AS max_amt, count(*) OVER () AS rows FROM txn"
    ),
}
