"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from txnrisk.operators import monitor, velocity
from txnrisk.queries.inputs import card_events
from txnrisk.session import run_folder
from txnrisk.streaming import rollup, score
from txnrisk.streaming.source import append_sink, drain, file_stream
from txnrisk.streaming.velocity import velocity_batches, velocity_stream


@pytest.fixture(scope="module")
def parts(spark):
    """Card events in four files that follow each other in time."""
    df = card_events(spark, SMALL).withColumn("cc_num", F.when(F.col("trans_num") % 2 == 0, F.lit(1)).otherwise(F.col("cc_num")))
    df = df.select("trans_num", "cc_num", "unix_time", "amt").cache()
    folder = run_folder(spark, "parts")
    edges = [0, *df.approxQuantile("unix_time", [0.25, 0.5, 0.75], 0), 1 << 40]
    for a, b in zip(edges, edges[1:], strict=False):
        df.where((F.col("unix_time") >= a) & (F.col("unix_time") < b)).coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def _run(spark, stream, name):
    folder = run_folder(spark, name)
    drain(append_sink(stream, f"{folder}/data", f"{folder}/progress"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def test_velocity_over_batches_equals_batch(spark, parts):
    df, folder = parts
    stream = file_stream(spark, folder, df.schema, files_per_batch=1)
    got = _run(spark, velocity_stream(stream), "velocity").drop("is_late")
    want = velocity.add_velocity(df).select(*got.columns)
    assert got.orderBy("trans_num").collect() == want.orderBy("trans_num").collect()


@pytest.mark.parametrize("heavy_rows", [10**9, 50])
def test_velocity_by_table_equals_batch(spark, parts, heavy_rows):
    df, folder = parts
    stream = file_stream(spark, folder, df.schema, files_per_batch=1)
    out = run_folder(spark, "batches")
    drain(velocity_batches(stream, f"{out}/seconds", f"{out}/data", f"{out}/progress", heavy_rows=heavy_rows))
    got = spark.read.parquet(f"{out}/data").drop("batch_id")
    want = velocity.add_velocity(df).select(*got.columns)
    assert got.orderBy("trans_num").collect() == want.orderBy("trans_num").collect()


def test_late_rows_are_marked_and_look_back(spark):
    schema = "trans_num long, cc_num long, unix_time long, amt double"
    folder = run_folder(spark, "late")
    for rows in ([(1, 5, 1000, 1.0), (2, 5, 5000, 2.0)], [(3, 5, 4000, 4.0), (4, 5, 6000, 8.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = file_stream(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)
    got = {r["trans_num"]: (r["TxnCount_1h"], r["TxnAmount_1h"], r["is_late"]) for r in _run(spark, velocity_stream(stream, {"1h": 3600}), "late").collect()}
    assert got[3] == (1, 1.0, 1) and got[4] == (2, 6.0, 0) and got[2][2] == 0


def test_rollup_equals_batch(spark, parts):
    df, folder = parts
    def decisions(rows):
        scored = rows.withColumn("scored_at", F.timestamp_seconds("unix_time"))
        return scored.withColumn("decision", F.when(F.col("trans_num") % 3 == 0, "DECLINE").otherwise("APPROVE"))

    stream = decisions(file_stream(spark, folder, df.schema, files_per_batch=1))
    out = run_folder(spark, "rollup")
    drain(rollup.store_rollup(rollup.rollup_stream(stream), f"{out}/data", f"{out}/progress"))
    got = rollup.read_rollup(spark.read.parquet(f"{out}/data")).orderBy("decision_date", "decision_hour").collect()
    assert got == monitor.hourly_rollup(decisions(df)).collect()


def test_replayed_rows_are_dropped(spark, parts):
    df, folder = parts
    stream = file_stream(spark, folder, df.schema, files_per_batch=1).withColumn("scored_at", F.timestamp_seconds("unix_time"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    out = _run(spark, score.dedup_stream(twice), "dedup")
    assert out.count() == df.count() == out.select("trans_num").distinct().count()


def test_enrichment_keeps_rows(spark, parts):
    df, folder = parts
    feed = df.groupBy("cc_num").agg(F.max("amt").alias("limit")).where("cc_num <> 1")
    out = _run(spark, score.enrich_stream(file_stream(spark, folder, df.schema), {"account": (feed, ["cc_num"])}), "enrich")
    assert out.count() == df.count() and out.where("limit IS NULL").count() == df.where("cc_num = 1").count()


def test_scoring_commits_a_replayed_batch_once(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from txnrisk.model.bundle import Bundle
    from txnrisk.model.encode import fit_encoders
    from txnrisk.model.train import fit, prepare
    from txnrisk.sources.files import read_decisions, write_decisions

    df = card_events(spark, SMALL)
    encoders, features = fit_encoders(df, ["MerchantCategory"]), ["amt", "IPRiskScore", "MerchantCategory"]
    ready = prepare(df.withColumn("MerchantCategory", F.lit(1)).withColumn("is_validation", F.col("trans_num") % 5 == 0), features)
    model = fit(ready, 2.0, {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 1})
    bundle = Bundle(PipelineModel([model]), encoders, features, ["MerchantCategory"], 0.5, None, None, None)
    rows = df.select(F.col("trans_num").cast("string").alias("trans_num"), "cc_num", "amt", "merchant", "IPRiskScore", "MerchantCategory")
    for _ in range(2):
        write_decisions(score.score_batch(rows, bundle), str(tmp_path / "log"), 0)
    log = read_decisions(spark, str(tmp_path / "log"))
    assert log.count() == rows.count() and log.where("is_fraud_actual <> -1 OR unix_time <> 0").isEmpty()
    raw = {r["trans_num"]: (r["cc_num"], r["amt"], r["merchant"]) for r in rows.collect()}
    assert all(raw[r["trans_num"]] == (r["cc_num"], r["amt"], r["merchant"]) for r in log.collect())
    views = score.monitor_snapshot(spark, str(tmp_path / "log"), 100)
    assert views["latest"].count() == 100 and views["kpis"].first()["total"] == 100
    assert views["hourly"].agg(F.sum(F.col("approved") + F.col("reviewed") + F.col("declined"))).first()[0] == rows.count()
