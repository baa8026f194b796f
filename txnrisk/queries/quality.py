"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators import correlation, histogram, profile, quality
from txnrisk.queries.inputs import (
    CARD_EVENT_COLUMNS,
    CARD_EVENT_NUMBERS,
    EVENTS_CUTOFF,
    ORDERS_CUTOFF,
    card_events,
    decision_log,
    order_txns,
    over_decisions,
    over_events,
    over_orders,
)
from txnrisk.queries.features import WIDE_SQL, wide_events
from txnrisk.schema import BINARY_FLAGS, DERIVED_FEATURES
from txnrisk.sources.files import split_period

_TEXT = ("merchant", "MerchantCategory", "IP_Country", "MerchantCountry", "CarrierType", "IdentityVerificationStatus")
_IDS = ("trans_num", "cc_num", "unix_time", "is_fraud")
_NUMERIC = [c for c in CARD_EVENT_COLUMNS if c not in (*_TEXT, *_IDS)]
_DESCRIBED = [*_NUMERIC, *DERIVED_FEATURES]
_WIDE_ONCE = WIDE_SQL.replace("wide AS (", "wide AS MATERIALIZED (")

_ATTRIBUTES = {
    "acct_age": "AccountAgeDays",
    "chargebacks": "ChargebackCount",
    "id_confidence": "IdentityConfidenceScore",
    "addr_consist": "AddressConsistencyScore",
    "prev_fraud_flag": "PreviousFraudFlag",
}


def _r(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _corr_sql(a, b):
    # corr is undefined for a constant side; say so as NULL.
    return (
        f"CASE WHEN stddev_pop({a}) FILTER (WHERE {b} IS NOT NULL) * stddev_pop({b}) FILTER (WHERE {a} IS NOT NULL) = 0 THEN NULL "
        f"ELSE round(corr({a}, {b}), 4) + 0.0 END"
    )


def _matrix_sql(n=20):
    """All pairs of numeric columns and of each with the label; the n strongest columns, then the label, make the matrix."""
    columns = [*_NUMERIC, "is_fraud"]
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {_corr_sql(a, b)} AS corr FROM txn" for i, a in enumerate(columns) for b in columns[i + 1 :])
    exact = " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN {_corr_sql(c, 'is_fraud')} IS NOT NULL THEN abs(corr({c}, is_fraud)) END AS r FROM txn" for c in _NUMERIC)
    return over_events(
        "SELECT CASE WHEN x.place > y.place THEN a ELSE b END AS row, CASE WHEN x.place > y.place THEN b ELSE a END AS col, corr "
        "FROM pairs JOIN places x ON x.feature = a JOIN places y ON y.feature = b",
        f"pairs AS MATERIALIZED ({pairs}), strength AS MATERIALIZED ({exact}), "
        f"places AS (SELECT feature, row_number() OVER (ORDER BY r DESC NULLS LAST, feature) AS place FROM strength QUALIFY place <= {n} "
        f"UNION ALL SELECT 'is_fraud', {n + 1})",
    ).replace("txn AS (SELECT", "txn AS MATERIALIZED (SELECT", 1)


def _bins(x, n, lo="lo", hi="hi"):
    return f"CAST(CASE WHEN {hi} = {lo} THEN 0 ELSE least(floor(({x} - {lo}) / ({hi} - {lo}) * {n}), {n - 1}) END AS INT)"


def _histogram_sql(source, x, n, by=None, own=False, lo=None, hi=None):
    value = f"least(greatest({x}, {lo}), {hi})" if lo is not None else x
    part = f"PARTITION BY {by}" if by and own else ""
    group = f"{by}, " if by else ""
    keys = "1, 2, 3, 4" if by else "1, 2, 3"
    total = f"sum(n) OVER (PARTITION BY {by})" if by else "sum(n) OVER ()"
    return (
        f"SELECT {group}bin, round(lo + bin * (hi - lo) / {n}, 9) AS bin_low, round(lo + (bin + 1) * (hi - lo) / {n}, 9) AS bin_high, n, "
        f"round(n / ({total} * (hi - lo) / {n}), 6) AS density FROM (SELECT {group}{_bins('x', n)} AS bin, lo, hi, count(*) AS n FROM "
        f"(SELECT {group}x, min(x) OVER ({part}) AS lo, max(x) OVER ({part}) AS hi FROM (SELECT {group}{value} AS x FROM {source})) GROUP BY {keys})"
    )


def _hist(df):
    return _r(_r(df, ["bin_low", "bin_high"], 9), ["density"])


def _customers(s, d):
    return profile.customer_profile(card_events(s, d), _ATTRIBUTES)


_ORDERED = "ORDER BY unix_time, trans_num"
_CUSTOMERS_SQL = (
    "cust AS (SELECT cc_num, avg(is_fraud) AS fraud_rate, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, count(is_fraud) AS total_txns, "
    + ", ".join(f"first({src} {_ORDERED}) FILTER (WHERE {src} IS NOT NULL) AS {new}" for new, src in _ATTRIBUTES.items())
    + " FROM txn GROUP BY cc_num)"
)


def _rate_sql(column, base):
    return over_events(
        f"SELECT {column}, fraud, n, round(fraud / n, 6) AS fraud_rate, round(b, 6) AS baseline, CAST(fraud / n > b AS INT) AS above_avg FROM "
        f"(SELECT {column}, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(is_fraud) AS n FROM txn WHERE {column} IS NOT NULL GROUP BY {column}) g, {base}"
    )


_OVERALL = "(SELECT avg(is_fraud) AS b FROM txn)"


def _group_mean(column):
    return f"(SELECT avg(r) AS b FROM (SELECT avg(is_fraud) AS r FROM txn GROUP BY {column}))"


def _rate(column, baseline):
    return lambda s, d: _r(quality.rate_by(card_events(s, d), column, baseline), ["fraud_rate", "baseline"])


QUERIES = {
    "class_balance": lambda s, d: _r(quality.class_balance(card_events(s, d)), ["fraud_rate", "legit_rate", "imbalance_ratio"]),
    "label_counts": lambda s, d: quality.label_counts({"train": _period(s, d)[0], "test": _period(s, d)[1]}),
    "period_split": lambda s, d: split_period(order_txns(s, d), "2000-01-01")[0]
    .select("trans_num", F.lit("train").alias("part"))
    .union(split_period(order_txns(s, d), "2000-01-01")[1].select("trans_num", F.lit("test").alias("part"))),
    "null_profile": lambda s, d: quality.null_profile(card_events(s, d)),
    "amount_summary": lambda s, d: _r(quality.amount_summary(card_events(s, d)), ["mean", "median", "p95"], 5),
    "winsorised_scores": lambda s, d: _r(
        quality.winsorise(card_events(s, d).select("trans_num", "EmailRiskScore", "amt"), "amt").select("trans_num", "amt"), ["amt"]
    ),
    "fraud_rate_by_hour": _rate("TransactionHour", "groups"),
    "fraud_rate_by_weekday": _rate("DayOfWeek", "groups"),
    "fraud_rate_by_category": _rate("MerchantCategory", "overall"),
    "night_day_rate": lambda s, d: _r(quality.night_day_rate(card_events(s, d)), ["fraud_rate"]),
    "top_categories": lambda s, d: _r(quality.top_rates(card_events(s, d), "MerchantCategory"), ["fraud_rate"]),
    "flag_rates": lambda s, d: _r(quality.flag_rates(wide_events(s, d), BINARY_FLAGS), ["fraud_rate_when_flagged", "coverage"]),
    "label_correlation": lambda s, d: _r(correlation.label_correlation(card_events(s, d), _NUMERIC, None), ["corr"], 4),
    "label_correlation_default": lambda s, d: _r(correlation.label_correlation(card_events(s, d), n=None), ["corr"], 4),
    "correlation_matrix": lambda s, d: _r(correlation.strongest_matrix(card_events(s, d), _NUMERIC, 20), ["corr"], 4),
    "customer_profile": lambda s, d: _r(_customers(s, d), ["fraud_rate"]),
    "customer_summary": lambda s, d: _r(profile.customer_summary(_customers(s, d)), ["age_prev_fraud", "age_no_prev_fraud"]),
    "score_histogram": lambda s, d: _hist(histogram.histogram(decision_log(s, d), "fraud_score", 50, by="decision")),
    "score_density": lambda s, d: _hist(histogram.histogram(card_events(s, d), "fraud_score", 100, by="is_fraud", own_range=True)),
    "amount_histogram": lambda s, d: _hist(
        histogram.histogram(card_events(s, d), "amt", 80, by="is_fraud", lo=0.0, hi=500.0)
    ),
    "feature_description": lambda s, d: _r(quality.describe_features(wide_events(s, d), _DESCRIBED), ["mean", "std", "min", "max"], 4),
}


def _period(s, d):
    df = card_events(s, d)
    return df.where(F.col("unix_time") < EVENTS_CUTOFF), df.where(F.col("unix_time") >= EVENTS_CUTOFF)


ORACLE = {
    "class_balance": over_events(
        "SELECT count(*) AS total, count(*) FILTER (WHERE is_fraud = 1) AS fraud, count(*) FILTER (WHERE is_fraud = 0) AS legit, "
        "round(avg(is_fraud), 6) AS fraud_rate, round(1 - avg(is_fraud), 6) AS legit_rate, "
        "round(count(*) FILTER (WHERE is_fraud = 0) / count(*) FILTER (WHERE is_fraud = 1), 6) AS imbalance_ratio FROM txn"
    ),
    "label_counts": over_events(
        f"SELECT CASE WHEN unix_time < {EVENTS_CUTOFF} THEN 'train' ELSE 'test' END AS dataset, is_fraud, count(*) AS n FROM txn GROUP BY 1, 2"
    ),
    "period_split": over_orders(
        f"SELECT trans_num, CASE WHEN unix_time < {ORDERS_CUTOFF} THEN 'train' ELSE 'test' END AS part FROM txn"
    ),
    "null_profile": over_events(
        'SELECT "column", null_count, round(null_count * 100 / total, 2) AS null_pct FROM ('
        + " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, count(*) AS total FROM txn" for c in CARD_EVENT_COLUMNS
        )
        + ') WHERE null_count > 0 ORDER BY null_count DESC, "column" LIMIT 20'
    ),
    "amount_summary": over_events(
        "SELECT is_fraud, round(avg(amt), 5) AS mean, round(quantile_cont(amt, 0.5), 5) AS median, round(quantile_cont(amt, 0.95), 5) AS p95, "
        "max(amt) AS max FROM txn GROUP BY is_fraud"
    ),
    "winsorised_scores": over_events(
        "SELECT trans_num, round(least(greatest(amt, lo), hi), 6) AS amt FROM txn, "
        "(SELECT quantile_cont(amt, 0.01) AS lo, quantile_cont(amt, 0.99) AS hi FROM txn)"
    ),
    "fraud_rate_by_hour": _rate_sql("TransactionHour", _group_mean("TransactionHour")),
    "fraud_rate_by_weekday": _rate_sql("DayOfWeek", _group_mean("DayOfWeek")),
    "fraud_rate_by_category": _rate_sql("MerchantCategory", _OVERALL),
    "night_day_rate": over_events(
        "SELECT CASE WHEN IsNightTxn = 1 THEN 'Night (midnight-5am)' ELSE 'Day (6am-11pm)' END AS period, CAST(sum(is_fraud) AS BIGINT) AS fraud, "
        "count(is_fraud) AS n, round(avg(is_fraud), 6) AS fraud_rate FROM txn GROUP BY IsNightTxn"
    ),
    "top_categories": over_events(
        "SELECT MerchantCategory, CAST(sum(is_fraud) AS BIGINT) AS fraud, count(is_fraud) AS n, round(avg(is_fraud), 6) AS fraud_rate FROM txn "
        "WHERE MerchantCategory IS NOT NULL GROUP BY 1 ORDER BY avg(is_fraud) DESC, 1 LIMIT 5"
    ),
    "flag_rates": over_events(
        "SELECT flag, round(rate, 6) AS fraud_rate_when_flagged, round(flagged_count / total, 6) AS coverage, flagged_count, "
        "CASE WHEN rate > 0.05 THEN 'high' WHEN rate > 0.01 THEN 'medium' ELSE 'low' END AS band FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS flag, avg(is_fraud) AS rate, count(*) AS flagged_count, (SELECT count(*) FROM txn) AS total FROM wide WHERE {c} = 1"
            for c in BINARY_FLAGS
        )
        + ") WHERE flagged_count > 0",
        _WIDE_ONCE,
    ),
    "label_correlation": over_events(" UNION ALL ".join(f"SELECT '{c}' AS feature, {_corr_sql(c, 'is_fraud')} AS corr FROM txn" for c in _NUMERIC)),
    "label_correlation_default": over_events(
        " UNION ALL ".join(f"SELECT '{c}' AS feature, {_corr_sql(c, 'is_fraud')} AS corr FROM txn" for c in CARD_EVENT_NUMBERS if c not in ("is_fraud", "cc_num", "unix_time"))
    ),
    "correlation_matrix": _matrix_sql(),
    "customer_profile": over_events("SELECT * REPLACE (round(fraud_rate, 6) AS fraud_rate) FROM cust", _CUSTOMERS_SQL),
    "customer_summary": over_events(
        "SELECT count(*) AS customers, count(*) FILTER (WHERE fraud_count > 0) AS with_any_fraud, count(*) FILTER (WHERE fraud_rate > 0.05) AS above_rate, "
        "round(avg(acct_age) FILTER (WHERE prev_fraud_flag = 1), 6) AS age_prev_fraud, round(avg(acct_age) FILTER (WHERE prev_fraud_flag = 0), 6) "
        "AS age_no_prev_fraud FROM cust",
        _CUSTOMERS_SQL,
    ),
    "score_histogram": over_decisions(_histogram_sql("decisions", "fraud_score", 50, by="decision")),
    "score_density": over_events(_histogram_sql("txn", "fraud_score", 100, by="is_fraud", own=True)),
    "amount_histogram": over_events(_histogram_sql("txn", "amt", 80, by="is_fraud", lo=0.0, hi=500.0)),
    "feature_description": over_events(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, "
            f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM wide"
            for c in _DESCRIBED
        ),
        _WIDE_ONCE,
    ),
}
