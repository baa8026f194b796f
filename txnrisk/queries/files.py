"""Tables written to files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrisk.operators.decide import decision_record
from txnrisk.queries.inputs import card_events, order_txns, over_events, over_orders
from txnrisk.session import run_folder
from txnrisk.sources import files

_COLUMNS = ["trans_num", "cc_num", "merchant", "unix_time", "amt", "MerchantCategory", "is_fraud"]


def _csv(spark, sf_dir):
    """Orders as a wide CSV with a header, read with the default schema: known columns typed, others as text."""
    folder = run_folder(spark, "csv")
    order_txns(spark, sf_dir).select(*_COLUMNS, F.col("nation").alias("extra_nation")).write.option("header", True).csv(f"{folder}/txns.csv")
    return files.read_transactions(spark, f"{folder}/txns.csv").select(*_COLUMNS, "extra_nation")


def _converted(spark, sf_dir):
    """Card events through gzip CSV and the conversion to Parquet by date."""
    folder = run_folder(spark, "csv")
    card_events(spark, sf_dir).select(*_COLUMNS).write.option("header", True).option("compression", "gzip").csv(f"{folder}/txns")
    files.csv_to_parquet(spark, f"{folder}/txns", f"{folder}/txns.parquet")
    back = files.read_transactions(spark, f"{folder}/txns.parquet")
    return back.select("trans_num", "amt", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"))


def _feed(spark, sf_dir):
    """The customer feed, its key checked."""
    return files.read_feed(spark, "customer", sf_dir, ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


def _scored(spark, sf_dir):
    """Scored events written with all columns as Parquet and as gzip CSV, joined again."""
    folder, scored = run_folder(spark, "scored"), card_events(spark, sf_dir).select("trans_num", "amt", "fraud_score")
    files.write_scored(scored, f"{folder}/parquet")
    files.write_scored(scored, f"{folder}/csv", csv=True)
    text = spark.read.option("header", True).csv(f"{folder}/csv")
    text = text.select(F.col("trans_num").cast("long").alias("trans_num"), F.col("fraud_score").cast("double").alias("csv_score"))
    back = spark.read.parquet(f"{folder}/parquet").join(text, "trans_num")
    return back.select("trans_num", "amt", F.round("fraud_score", 9).alias("fraud_score"), F.round("csv_score", 9).alias("csv_score"))


def _stamped(spark, sf_dir):
    """Decision records with the default stamp: one for the batch, of today."""
    out = decision_record(card_events(spark, sf_dir))
    age = F.abs(F.unix_seconds(F.current_timestamp()) - F.unix_seconds("scored_at"))
    return out.select("trans_num", "decision", (age < 86_400).cast("int").alias("stamped_now"))


QUERIES = {
    "csv_transactions": _csv,
    "csv_conversion": _converted,
    "feed_with_unique_key": _feed,
    "scored_output": _scored,
    "decision_stamp": _stamped,
}

ORACLE = {
    "csv_transactions": over_orders(
        "SELECT CAST(trans_num AS VARCHAR) AS trans_num, cc_num, CAST(merchant AS VARCHAR) AS merchant, unix_time, amt, MerchantCategory, is_fraud, "
        "CAST(nation AS VARCHAR) AS extra_nation FROM txn"
    ),
    "csv_conversion": over_events(
        "SELECT CAST(trans_num AS VARCHAR) AS trans_num, amt, strftime(make_timestamp(unix_time * 1000000), '%Y-%m-%d') AS event_date FROM txn"
    ),
    "feed_with_unique_key": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "scored_output": over_events("SELECT trans_num, amt, round(fraud_score, 9) AS fraud_score, round(fraud_score, 9) AS csv_score FROM txn"),
    "decision_stamp": over_events(
        "SELECT trans_num, CASE WHEN fraud_score >= 0.8895 THEN 'DECLINE' WHEN fraud_score >= 0.30 THEN 'REVIEW' ELSE 'APPROVE' END AS decision, "
        "1 AS stamped_now FROM txn"
    ),
}
