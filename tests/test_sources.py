"""Files in and out."""

import gzip

import pytest

from tests.conftest import SMALL
from txnrisk.queries.inputs import decision_log, order_txns
from txnrisk.sources import files


def test_gzip_csv_with_header_and_nan(spark, tmp_path):
    path = str(tmp_path / "txns.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write("trans_num,cc_num,merchant,unix_time,amt,is_fraud\n")
        f.write("t1,7,shop,1577836800,12.5,0\nt2,8,,1577836799,NaN,1\nt3,,x,1577923200,,\n")
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("trans_num string, cc_num long, merchant string, unix_time long, amt double, is_fraud int")
    rows = {r["trans_num"]: r for r in files.read_transactions(spark, path, schema).collect()}
    assert rows["t1"]["amt"] == 12.5 and rows["t2"]["amt"] is None and rows["t2"]["merchant"] is None and rows["t3"]["cc_num"] is None
    inferred = files.read_transactions(spark, path, None)
    assert dict(inferred.dtypes)["amt"] == "double" and inferred.count() == 3

    target = str(tmp_path / "txns.parquet")
    files.csv_to_parquet(spark, path, target, schema, partitions=2)
    train, test = files.split_period(files.read_transactions(spark, target))
    assert {r["trans_num"] for r in train.collect()} == {"t2"} and {r["trans_num"] for r in test.collect()} == {"t1", "t3"}
    assert "PartitionFilters: [isnotnull(event_date" in train._jdf.queryExecution().toString()


def test_contract_defaults_and_extras(spark):
    df = spark.createDataFrame([("abc", "12", "x", 1.5), (None, "zz", None, None)], "trans_num string, cc_num string, merchant string, extra double")
    a, b = files.conform(df).collect()
    assert a.asDict() == {"trans_num": "abc", "cc_num": 12, "merchant": "x", "unix_time": 0, "amt": 0.0, "is_fraud": -1, "extra": 1.5}
    assert (b["trans_num"], b["cc_num"], b["merchant"], b["extra"]) == ("", 0, "", None)


def test_decisions_are_stored_once_per_batch(spark, tmp_path):
    log = decision_log(spark, SMALL)
    path = str(tmp_path / "log")
    for batch in (0, 1, 1):
        files.write_decisions(log.where(f"trans_num % 2 = {batch}"), path, batch)
    back = files.read_decisions(spark, path)
    assert back.count() == log.count() and back.select("trans_num").distinct().count() == log.count()
    late = files.read_decisions(spark, path, "2024-01-20")
    assert 0 < late.count() == log.where("scored_at >= '2024-01-20'").count()
    assert "PartitionFilters: [isnotnull(decision_date" in late._jdf.queryExecution().toString()
    plain = str(tmp_path / "plain")
    files.write_decisions(log.limit(5), plain)
    files.write_decisions(log.limit(5), plain)
    assert files.read_decisions(spark, plain).count() == 10


def test_scored_output(spark, tmp_path):
    df = order_txns(spark, SMALL).select("trans_num", "amt").limit(7)
    files.write_scored(df, str(tmp_path / "a"))
    files.write_scored(df, str(tmp_path / "b"), csv=True)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 7
    assert spark.read.option("header", True).csv(str(tmp_path / "b")).columns == ["trans_num", "amt"]


def test_feed_keys_must_be_unique(spark):
    assert files.read_feed(spark, "customer", SMALL, ["c_custkey"]).count() > 0
    with pytest.raises(ValueError, match="duplicate keys"):
        files.read_feed(spark, "lineitem", SMALL, ["l_orderkey", "l_linenumber"])


def test_conversion_of_a_gzip_folder_is_cut_by_its_text(spark, tmp_path, monkeypatch):
    rows = spark.range(4_000).selectExpr("CAST(id AS STRING) AS trans_num", "id % 7 AS cc_num", "1577836800L + id AS unix_time", "CAST(id AS DOUBLE) AS amt")
    source, target = str(tmp_path / "txns"), str(tmp_path / "txns.parquet")
    rows.coalesce(2).write.option("header", True).option("compression", "gzip").csv(source)
    stored = sum(p.stat().st_size for p in (tmp_path / "txns").glob("*.gz"))
    assert files.text_bytes(spark, source) == 10 * stored
    monkeypatch.setattr(files, "CONVERTED_BYTES", stored * 10 // 5)
    files.csv_to_parquet(spark, source, target)
    # All rows lie in one date.
    assert len(list((tmp_path / "txns.parquet").glob("event_date=*/*.parquet"))) >= 5
    back = files.read_transactions(spark, target)
    assert {(r["trans_num"], r["amt"]) for r in back.collect()} == {(str(i), float(i)) for i in range(4_000)}
