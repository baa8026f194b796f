"""Online state, map state and merged runs give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SMALL
from txnrisk.operators import asof, velocity
from txnrisk.queries.inputs import EVENTS_CUTOFF, card_events, login_feed
from txnrisk.session import run_folder
from txnrisk.streaming import features, rollup, runs, seconds
from txnrisk.streaming.source import append_sink, drain, file_stream


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_runs_cover_every_batch_once(fan):
    for n in range(200):
        found = [b for level, run in runs.covering(n, fan) for b in range(run * fan**level, (run + 1) * fan**level)]
        assert found == list(range(n))
    assert max(len(runs.covering(n, 8)) for n in range(64, 512)) <= 21


def test_store_opens_few_runs_over_fifty_batches(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    store = runs.RunStore(spark, run_folder(spark, "runs"), schema, lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), fan=4)
    opened = []
    for b in range(50):
        store.append(spark.createDataFrame([(b % 5, 1), (b % 5, 1)], schema), b)
        if b in (6, 20):
            store.append(spark.createDataFrame([(b % 5, 1), (b % 5, 1)], schema), b)  # a replay
        opened.append(len(runs.covering(b + 1, 4)))
    assert store.newest() == 49 and max(opened[15:]) <= 9
    got = store.merge(store.through(49)).collect()
    assert sorted(tuple(r) for r in got) == [(k, 20) for k in range(5)]
    assert store.before(0).count() == 0


def _hot(spark):
    df = card_events(spark, SMALL)
    return df.withColumn("cc_num", F.when(F.col("trans_num") % 2 == 0, F.lit(3)).otherwise(F.col("cc_num")))


def _equal(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert a.select(*columns).orderBy("trans_num").collect() == b.select(*columns).orderBy("trans_num").collect()


@pytest.mark.parametrize("heavy_rows", [10**9, 100])
def test_online_features_equal_batch(spark, heavy_rows):
    df, logins = _hot(spark), login_feed(spark, SMALL)
    profiles = asof.fit_profiles(df.where(F.col("unix_time") < EVENTS_CUTOFF))
    want = asof.derive_asof(df, profiles, logins)
    online = features.OnlineFeatures(spark, run_folder(spark, "online"), df.schema, profiles, heavy_rows=heavy_rows, fan=2)
    folder, cuts = run_folder(spark, "slices"), df.approxQuantile("unix_time", [0.2, 0.5, 0.6, 0.9], 0)
    for b, (low, high) in enumerate(zip([0, *cuts], [*cuts, 1 << 40], strict=True)):
        inside = (F.col("unix_time") >= low) & (F.col("unix_time") < high)
        for _ in range(2 if b == 3 else 1):  # a replayed micro-batch gives the same
            online.advance(df.where(inside), logins.where(inside), b).write.mode("overwrite").parquet(f"{folder}/b={b}")
    _equal(spark.read.parquet(folder).drop("b"), want)


def test_holdout_labels_reach_no_feature(spark):
    df = card_events(spark, SMALL)
    late = F.col("unix_time") >= EVENTS_CUTOFF
    flipped = df.withColumn("is_fraud", F.when(late, 1 - F.col("is_fraud")).otherwise(F.col("is_fraud")))
    logins = login_feed(spark, SMALL)
    got = [asof.derive_asof(d, asof.fit_profiles(d.where(~late)), logins).drop("is_fraud") for d in (df, flipped)]
    _equal(*got)


def test_cards_without_a_profile(spark):
    df = card_events(spark, SMALL)
    early = df.where((F.col("unix_time") < EVENTS_CUTOFF) & (F.col("cc_num") != 1) & (F.col("merchant") != "m_1"))
    out = asof.attach_profiles(df, asof.fit_profiles(early))
    new = out.where("cc_num = 1")
    assert new.count() and new.where("AmountZScore IS NOT NULL OR TimeOfDayDeviation IS NOT NULL OR InterArrivalEntropy <> 0").isEmpty()
    assert new.where("MerchantCategory IS NOT NULL AND CategoryDeviationScore <> 1").isEmpty()
    assert out.where("merchant = 'm_1' AND (MerchantAmountZScore IS NOT NULL OR SharedMerchantFraudRate IS NOT NULL)").isEmpty()


def test_scoring_raises_on_absent_features(spark):
    from txnrisk.model.bundle import Bundle

    bundle = Bundle(None, None, ["amt", "gone"], [], 0.5, None, None, None)
    with pytest.raises(ValueError, match="gone"):
        bundle.require(card_events(spark, SMALL))


def _versions(spark, slices, **options):
    seconds.use_rocksdb(spark)
    folder = run_folder(spark, "versions")
    query = None
    for i, rows in enumerate(slices):
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = file_stream(spark, f"{folder}/in", rows.schema)
        out = seconds.velocity_versions(stream, **options)
        query = append_sink(out, f"{folder}/data", f"{folder}/progress")
        drain(query)
    return spark.read.schema(out.schema).parquet(f"{folder}/data"), query.lastProgress


@pytest.mark.parametrize("order", ["time", "any"])
def test_newest_versions_equal_batch(spark, order):
    df = _hot(spark).select("trans_num", "cc_num", "unix_time", "amt").withColumn("amt", F.when(F.col("trans_num") % 17 != 0, F.col("amt")))
    rank = F.col("unix_time") if order == "time" else F.pmod(F.xxhash64("trans_num"), F.lit(1_000))
    cuts = df.select(rank.alias("r")).approxQuantile("r", [0.3, 0.7], 0)
    slices = [df.where((rank >= a) & (rank < b)) for a, b in zip([-1, *cuts], [*cuts, 1 << 40], strict=True)]
    out, progress = _versions(spark, slices, lateness=1 << 32)
    newest = seconds.newest_versions(out).drop("version")
    _equal(newest, velocity.add_velocity(df).select(*newest.columns))
    written = progress["stateOperators"][0]["numRowsUpdated"]
    last = slices[-1].select("cc_num", "unix_time").distinct().count()
    assert out.where("version > 0").isEmpty() == (order == "time")
    if order == "time":  # only the seconds of the micro-batch are written
        assert 0 < written <= last


def test_late_rows_are_corrected_by_a_version(spark):
    schema = "trans_num long, cc_num long, unix_time long, amt double"
    first = [(1, 5, 1_000, 1.0), (2, 5, 5_000, 2.0), (3, 5, 90_000, 8.0), (4, None, 1_000, 1.0)]
    late = [(5, 5, 4_000, 4.0), (6, None, 500, 1.0), (7, 5, None, 1.0)]
    slices = [spark.createDataFrame(rows, schema) for rows in (first, late)]
    out, _ = _versions(spark, slices, horizons={"1h": 3_600, "24h": 86_400})
    got = {(r.trans_num, r.version): (r.TxnCount_1h, r.TxnAmount_1h, r.TxnCount_24h) for r in out.collect()}
    assert got[5, 0] == (1, 1.0, 1) and got[2, 0] == (0, 0.0, 1) and got[2, 1] == (1, 4.0, 2) and got[3, 1] == (0, 0.0, 2)
    assert got[4, 1] == (1, 1.0, 1) and (1, 1) not in got and not any(t == 7 for t, _ in got)
    plain, _ = _versions(spark, slices, horizons={"1h": 3_600}, correct=False)
    assert {r.version for r in plain.collect()} == {0}


def test_rollup_runs_equal_batch(spark):
    from txnrisk.operators import monitor

    rows = card_events(spark, SMALL).select("trans_num", F.timestamp_seconds("unix_time").alias("scored_at"))
    rows = rows.withColumn("decision", F.when(F.col("trans_num") % 3 == 0, "DECLINE").otherwise("APPROVE"))
    folder = run_folder(spark, "rollup")
    for part in range(5):  # any order of arrival
        rows.where(F.pmod(F.xxhash64("trans_num"), F.lit(5)) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    store = rollup.rollup_store(spark, f"{folder}/hours", fan=2)
    drain(rollup.store_rollup_runs(file_stream(spark, f"{folder}/in", rows.schema, files_per_batch=1), store, f"{folder}/progress"))
    assert rollup.read_rollup_runs(store).orderBy("decision_date", "decision_hour").collect() == monitor.hourly_rollup(rows).collect()


def test_prior_rank_by_hand(spark):
    from txnrisk.operators import sequence

    rng = random.Random(3)
    rows = [(i, i % 3 if i % 11 else None, rng.randrange(40), rng.choice([None, 1.0, 2.0, rng.random() * 9, 5.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "trans_num long, cc_num long, unix_time long, amt double")
    want = {}
    for t, c, u, a in rows:
        earlier = [x for tt, cc, uu, x in rows if cc == c and (uu, tt) < (u, t) and x is not None]
        want[t] = None if a is None else sum(x < a for x in earlier) / len(earlier) if earlier else 0.0
    for limit in (10**9, 20_000, 120, 0):
        got = {r.trans_num: r.PriorAmountPercentileRank for r in sequence.add_prior_amount_rank(df, limit).collect()}
        assert got.keys() == want.keys()
        assert all(got[t] is None if w is None else abs(got[t] - w) < 1e-12 for t, w in want.items())


@pytest.mark.parametrize("order", ["time", "any"])
def test_asof_stream_equals_batch(spark, order):
    from txnrisk.operators import account
    from txnrisk.streaming.asof import asof_stream

    rng = random.Random(9)
    txn = [(i, rng.choice([1, 2, None]), rng.randrange(60)) for i in range(120)] + [(500, 1, None)]
    events = [(rng.choice([1, 2, None]), rng.randrange(60)) for _ in range(25)] + [(3, 5), (1, None)]
    seconds.use_rocksdb(spark)
    a, b = "trans_num long, cc_num long, unix_time long", "cc_num long, unix_time long"
    df, feed = spark.createDataFrame(txn, a), spark.createDataFrame(events, b)
    folder, out = run_folder(spark, "asof"), None
    for part in range(3):
        for name, rows, schema in (("txn", txn, a), ("events", events, b)):
            own = [r for i, r in enumerate(rows) if (i % 3 if order == "any" else min(2, (r[-1] or 0) // 20)) == part]
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
        streams = [file_stream(spark, f"{folder}/{name}", d.schema) for name, d in (("txn", df), ("events", feed))]
        joined = asof_stream(*streams, "cc_num", "unix_time", "trans_num", "changed_at", lateness=100 if order == "any" else 25)
        drain(append_sink(joined, f"{folder}/data", f"{folder}/progress"))
    out = spark.read.schema(joined.schema).parquet(f"{folder}/data")
    got = seconds.newest_versions(out).drop("version")
    want = account.asof_latest(df.where("unix_time IS NOT NULL"), feed.where("unix_time IS NOT NULL"), "cc_num", "unix_time", "changed_at")
    _equal(got, want.select(*got.columns))
    assert order == "time" or not out.where("version > 0").isEmpty()


def test_online_windows_carry_the_other_columns_as_one(spark, monkeypatch):
    df, logins = card_events(spark, SMALL), login_feed(spark, SMALL)
    profiles = asof.fit_profiles(df.where(F.col("unix_time") < EVENTS_CUTOFF))
    online = features.OnlineFeatures(spark, run_folder(spark, "online"), df.schema, profiles)
    seen = []
    for module in (asof, features):  # whichever of them runs the steps
        if hasattr(module, "run_steps"):
            run = module.run_steps
            monkeypatch.setattr(module, "run_steps", lambda rows, *a, run=run, **k: (seen.append(rows.columns), run(rows, *a, **k))[1])
    online.advance(df, logins, 0)
    assert len(seen) == 1 and set(seen[0]) == {*asof.PAST_COLUMNS, "_rest", "_past"}
