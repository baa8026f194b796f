"""Transaction-shaped views of the driver tables, in Spark and as SQL text for the oracle.

``card_events`` reads ``events`` as card transactions, ``orders`` are transactions over several years, the
login feed and the decision log are further readings of ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.session import tune

# Cut-offs of the train period inside each input.
EVENTS_CUTOFF = 1_705_708_800  # 2024-01-20
ORDERS_CUTOFF = 946_684_800  # 2000-01-01

# name -> SQL over (event_id, user_id, event_type, value, k, secs); reads the same in both engines.
CARD_EVENT_COLUMNS = {
    "trans_num": "event_id",
    "cc_num": "user_id",
    "unix_time": "secs",
    "amt": "value",
    "merchant": "'m_' || CAST(event_id % 97 AS STRING)",
    "MerchantCategory": "CASE WHEN event_id % 41 <> 0 THEN 'c_' || CAST(k % 7 AS STRING) END",
    "is_fraud": "CAST(event_type = 'error' AS INT)",
    "cust_lat": "CAST(user_id * 37 % 120 - 60 AS DOUBLE)",
    "cust_long": "CAST(user_id * 53 % 360 - 180 AS DOUBLE)",
    "merch_lat": "CAST((event_id % 97) * 29 % 120 - 60 AS DOUBLE)",
    "merch_long": "CAST((event_id % 97) * 71 % 360 - 180 AS DOUBLE)",
    "TransactionHour": "CAST(FLOOR((secs % 86400) / 3600) AS INT)",
    "DayOfWeek": "CAST((FLOOR(secs / 86400) + 4) % 7 + 1 AS INT)",
    "IsWeekend": "CAST((FLOOR(secs / 86400) + 4) % 7 IN (0, 6) AS INT)",
    "IsNightTxn": "CAST((secs % 86400) < 21600 AS INT)",
    "IPRiskScore": "CAST((event_id * 31 + user_id * 17) % 101 AS DOUBLE)",
    "EmailRiskScore": "CASE WHEN event_id % 13 <> 0 THEN CAST((event_id * 43 + user_id) % 101 AS DOUBLE) END",
    "PhoneRiskScore": "CAST((event_id * 47 + user_id * 5) % 101 AS DOUBLE)",
    "AddressRiskScore": "CAST((event_id * 67 + user_id * 3) % 101 AS DOUBLE)",
    "BotLikelihoodScore": "CAST((event_id * 7 + k) % 101 AS DOUBLE) / 100",
    "MerchantRiskScore": "CAST((event_id % 97) * 73 % 101 AS DOUBLE)",
    "DeviceTrustScore": "CAST(event_id * 59 % 101 AS DOUBLE)",
    "HistoricalVelocityScore": "CAST((event_id * 83 + user_id) % 101 AS DOUBLE)",
    "SSNMatchScore": "CAST((event_id * 61 + k) % 101 AS DOUBLE) / 100",
    "IsVPN": "CAST(event_id % 11 = 0 AS INT)",
    "IsTor": "CAST(event_id % 53 = 0 AS INT)",
    "IsProxy": "CAST(event_id % 29 = 0 AS INT)",
    "IsNewDevice": "CAST(event_id % 7 = 0 AS INT)",
    "IPCountryMismatch": "CAST(event_id % 17 = 0 AS INT)",
    "IsDisposableEmail": "CAST(event_id % 19 = 0 AS INT)",
    "IsVOIP": "CAST(event_id % 31 = 0 AS INT)",
    "SyntheticIdentityFlag": "CAST(event_id % 23 = 0 AS INT)",
    "IsCommercialAddress": "CAST(event_id % 37 = 0 AS INT)",
    "IsHighRiskCategory": "CASE WHEN event_id % 41 <> 0 THEN CAST(k % 7 = 3 AS INT) END",
    "DeviceBlacklisted": "0",
    "PreviousFraudFlag": "CAST(user_id % 9 = 0 AS INT)",
    "ChargebackCount": "CAST(user_id % 6 AS INT)",
    "AccountAgeDays": "CAST(user_id * 29 % 900 AS INT)",
    "NumAccountsOnDevice": "CAST(1 + user_id % 5 AS INT)",
    "IdentityConfidenceScore": "CAST(user_id * 41 % 101 AS DOUBLE) / 100",
    "AddressConsistencyScore": "CASE WHEN event_id % 5 <> 0 THEN CAST(user_id * 43 % 101 AS DOUBLE) / 100 END",
    "SessionDurationSec": "CAST((event_id * 89 + k) % 1801 AS DOUBLE)",
    "CheckoutTimeSec": "CAST((event_id * 97 + k) % 301 AS DOUBLE)",
    "IP_Country": "'n_' || CAST(event_id % 25 AS STRING)",
    "MerchantCountry": "'n_' || CAST((event_id % 97) % 25 AS STRING)",
    "CarrierType": "CASE WHEN event_id % 43 <> 0 THEN 't_' || CAST(user_id % 4 AS STRING) END",
    "IdentityVerificationStatus": "CASE user_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' ELSE 'failed' END",
    "fraud_score": "CAST((event_id * 7919 + user_id * 104729) % 1000003 AS DOUBLE) / 1000003",
}

# The numeric columns: all but those whose definition gives text.
CARD_EVENT_NUMBERS = [c for c, sql in CARD_EVENT_COLUMNS.items() if "'" not in sql.replace("'error'", "")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch(column: str) -> str:
    return f"unix_seconds(CAST({column} AS TIMESTAMP))"


def events_base(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id", "user_id", "event_type", "value", "ts",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", f"{_epoch('ts')} AS secs",
    )


def as_card_events(events: DataFrame) -> DataFrame:
    return events_base(events).selectExpr(*[f"{sql} AS {name}" for name, sql in CARD_EVENT_COLUMNS.items()])


def card_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_card_events(table(spark, sf_dir, "events"))


def order_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    def read(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    first_supplier = read("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("merchant"))
    joined = (
        read("orders")
        .join(first_supplier, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(read("supplier"), F.col("merchant") == F.col("s_suppkey"), "left")
    )
    return joined.selectExpr(
        "o_orderkey AS trans_num", "o_custkey AS cc_num", "o_totalprice AS amt",
        f"{_epoch('o_orderdate')} AS unix_time", "merchant", "c_mktsegment AS MerchantCategory",
        "CAST(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS INT) AS is_fraud",
        "CAST(c_nationkey * 7 - 90 AS DOUBLE) AS cust_lat", "CAST(c_nationkey * 14 - 180 AS DOUBLE) AS cust_long",
        "CAST(s_nationkey * 7 - 90 AS DOUBLE) AS merch_lat", "CAST(s_nationkey * 14 - 180 AS DOUBLE) AS merch_long",
        "CAST(o_orderdate AS DATE) AS event_date", "c_nationkey AS nation",
    )


def as_logins(events: DataFrame) -> DataFrame:
    """Every event but a sign-up is a login attempt, an error a failed one, a sign-up a password change."""
    return events_base(events).selectExpr(
        "user_id AS cc_num", "secs AS unix_time", "CAST(event_type = 'error' AS INT) AS is_failure",
        "CAST(event_type = 'signup' AS INT) AS is_password_change",
    )


def login_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_logins(table(spark, sf_dir, "events"))


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    from txnrisk.operators.decide import decide

    scored = events_base(table(spark, sf_dir, "events")).selectExpr(
        *[f"{CARD_EVENT_COLUMNS[c]} AS {c}" for c in ("trans_num", "cc_num", "merchant", "unix_time", "amt")],
        f"round({CARD_EVENT_COLUMNS['fraud_score']}, 6) AS fraud_score",
        f"{CARD_EVENT_COLUMNS['is_fraud']} AS is_fraud_actual",
        "CAST(ts AS TIMESTAMP) AS scored_at",
    )
    return scored.withColumn("decision", decide("fraud_score"))


# ---- the same inputs as SQL for the oracle ----

_EVENTS_BASE_SQL = (
    "SELECT event_id, user_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
    "CAST(floor(epoch(ts)) AS BIGINT) AS secs FROM events"
)


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


EVENTS_SQL = f"base AS ({_EVENTS_BASE_SQL}), txn AS (SELECT {_list(CARD_EVENT_COLUMNS)} FROM base)"

ORDERS_SQL = """txn AS (
  SELECT o_orderkey AS trans_num, o_custkey AS cc_num, o_totalprice AS amt,
         CAST(floor(epoch(o_orderdate)) AS BIGINT) AS unix_time, m.merchant, c_mktsegment AS MerchantCategory,
         CAST(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AS INT) AS is_fraud,
         CAST(c_nationkey * 7 - 90 AS DOUBLE) AS cust_lat, CAST(c_nationkey * 14 - 180 AS DOUBLE) AS cust_long,
         CAST(s_nationkey * 7 - 90 AS DOUBLE) AS merch_lat, CAST(s_nationkey * 14 - 180 AS DOUBLE) AS merch_long,
         CAST(o_orderdate AS DATE) AS event_date, c_nationkey AS nation
  FROM orders
  LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS merchant FROM lineitem GROUP BY l_orderkey) m ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON m.merchant = s_suppkey)"""

LOGINS_SQL = (
    "logins AS (SELECT user_id AS cc_num, secs AS unix_time, CAST(event_type = 'error' AS INT) AS is_failure, "
    "CAST(event_type = 'signup' AS INT) AS is_password_change FROM base)"
)

_LOG_COLUMNS = {c: CARD_EVENT_COLUMNS[c] for c in ("trans_num", "cc_num", "merchant", "unix_time", "amt")}

DECISIONS_SQL = (
    f"base AS ({_EVENTS_BASE_SQL}), "
    f"scored AS (SELECT {_list(_LOG_COLUMNS)}, round({CARD_EVENT_COLUMNS['fraud_score']}, 6) AS fraud_score, "
    f"{CARD_EVENT_COLUMNS['is_fraud']} AS is_fraud_actual, ts AS scored_at FROM base), "
    "decisions AS (SELECT *, CASE WHEN fraud_score >= 0.8895 THEN 'DECLINE' WHEN fraud_score >= 0.30 THEN 'REVIEW' "
    "ELSE 'APPROVE' END AS decision FROM scored)"
)


def over_events(body: str, more: str = "") -> str:
    return f"WITH {EVENTS_SQL}{', ' + more if more else ''} {body}"


def over_orders(body: str, more: str = "") -> str:
    return f"WITH {ORDERS_SQL}{', ' + more if more else ''} {body}"


def over_decisions(body: str, more: str = "") -> str:
    return f"WITH {DECISIONS_SQL}{', ' + more if more else ''} {body}"
