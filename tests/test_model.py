"""Encoding, splits, training, bundle, importance."""

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from tests.conftest import SMALL
from txnrisk.model import encode, importance, split
from txnrisk.model.bundle import load_bundle, save_bundle
from txnrisk.model import train as learn
from txnrisk.model.train import prepare, random_params, train, tune
from txnrisk.queries.inputs import EVENTS_CUTOFF, card_events


def test_codes_follow_category_order(spark):
    df = spark.createDataFrame([("b", 10), ("a", 2), (None, 2), ("a", None)], "c string, h int")
    codes = {(r["column"], r["category"]): r["code"] for r in encode.fit_encoders(df, ["c", "h"]).collect()}
    assert codes == {("c", "__NA__"): 0, ("c", "a"): 1, ("c", "b"): 2, ("h", "2"): 0, ("h", "10"): 1, ("h", "__NA__"): 2}


def test_short_dictionaries_are_looked_up_without_joins(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"c{i % 5}" if i % 7 else None, i % 3) for i in range(60)], "id int, c string, h int")
    new = df.withColumn("c", F.when(F.col("id") == 8, "other").otherwise(F.col("c")))
    fitted = learn.materialise(encode.fit_encoders(df, ["c", "h"]), "encoders")
    mapped = encode.apply_encoders(new, fitted, ["c", "h"])
    assert "Join" not in mapped._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(encode, "MAPPED_ROWS", 4)  # c has six categories, h three
    joined = encode.apply_encoders(new, fitted, ["c", "h"])
    assert joined._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 1
    assert mapped.schema == joined.schema
    rows = sorted(mapped.collect())
    assert rows == sorted(joined.collect()) and rows[8].c == -1 and rows[7].c == 0


def test_categories_that_come_twice_or_are_null_are_joined_as_before(spark):
    encoders = spark.createDataFrame([("c", "a", 0), ("c", "a", 1), ("d", None, 5), ("d", "x", 3)], "column string, category string, code int")
    df = spark.createDataFrame([("a", "x"), (None, None)], "c string, d string")
    assert sorted(encode.apply_encoders(df, encoders, ["c", "d"]).collect()) == [(-1, -1), (0, 3), (1, 3)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_unseen_null_and_missing(spark, monkeypatch, limit):
    monkeypatch.setattr(encode, "BROADCAST_BYTES", limit)
    fitted = encode.fit_encoders(spark.createDataFrame([("a",), (None,)], "c string"), ["c"])
    new = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, c string")
    got = {r["id"]: (r["c"], r["gone"]) for r in encode.apply_encoders(new, fitted, ["c", "gone"]).collect()}
    assert got == {1: (1, -1), 2: (-1, -1), 3: (0, -1)}
    first = encode.fit_encoders(spark.createDataFrame([("b",), ("a",)], "c string"), ["c"], null_as="nan")
    assert {r["id"]: r["c"] for r in encode.apply_encoders_first(new, first, ["c"]).collect()} == {1: 0, 2: 0, 3: 0}


def test_feature_order_is_stable(spark):
    df = card_events(spark, SMALL)
    names = encode.feature_columns(df.schema)
    assert names == encode.feature_columns(df.schema) and names[-1] == "IdentityVerificationStatus"
    assert not {"trans_num", "cc_num", "unix_time", "is_fraud", "merch_lat"} & set(names)


def test_unreadable_inputs_become_the_sentinel(spark):
    df = spark.createDataFrame([("1.5", None), ("oops", 2.0)], "a string, b double")
    rows = encode.numeric_inputs(df, ["b", "a", "absent"]).collect()
    assert [tuple(r) for r in rows] == [(-999.0, 1.5, -999.0), (2.0, -999.0, -999.0)]


@pytest.mark.parametrize("exact", [False, True])
def test_split_is_disjoint_complete_and_repeatable(spark, exact):
    df = card_events(spark, SMALL).select("trans_num", "is_fraud")
    a, b = split.stratified_split(df, 0.25, exact=exact)
    left, right = ({r["trans_num"] for r in p.collect()} for p in (a, b))
    assert not left & right and len(left | right) == df.count()
    again = split.stratified_split(df.repartition(7), 0.25, exact=exact)[1]
    assert {r["trans_num"] for r in again.collect()} == right
    for label in (0, 1):
        n = df.where(f"is_fraud = {label}").count()
        held = b.where(f"is_fraud = {label}").count()
        assert held == round(n * 0.25) if exact else abs(held / n - 0.25) < 0.08


def test_sample_is_repeatable(spark):
    df = card_events(spark, SMALL).select("trans_num", "is_fraud")
    a = split.seeded_sample(df, 30, by="is_fraud")
    b = split.seeded_sample(df.repartition(5), 30, by="is_fraud")
    assert a.count() == 60 and {r[0] for r in a.collect()} == {r[0] for r in b.collect()}
    assert {r[0] for r in split.seeded_sample(df, 30, 1).collect()} != {r[0] for r in split.seeded_sample(df, 30, 2).collect()}


@pytest.fixture(scope="module")
def data(spark):
    """A label that the inputs explain, so that a few rounds learn something."""
    df = card_events(spark, SMALL.replace("sf0.001", "sf0.01")).drop("fraud_score")
    y = ((F.col("BotLikelihoodScore") > 0.7) & (F.col("CarrierType") == "t_1")) | (F.col("amt") > 150)
    df = df.withColumn("is_fraud", F.coalesce(y, F.lit(False)).cast("int"))
    return df.where(F.col("unix_time") < EVENTS_CUTOFF), df.where(F.col("unix_time") >= EVENTS_CUTOFF)


PARAMS = {"maxIter": 12, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": 10}


@pytest.fixture(scope="module")
def bundle(spark, data):
    return train(*data, PARAMS)


def test_training_learns(bundle):
    report = {r["metric"]: r["value"] for r in bundle.report.collect()}
    assert report["pr_auc"] > 0.9 and report["roc_auc"] > 0.95 and report["threshold"] == bundle.threshold
    assert report["tp"] + report["fn"] > 0 and report["fraud_caught"] == pytest.approx(report["recall"])
    top = [r["feature"] for r in importance.top_importance(bundle.importance, 3).collect()]
    assert set(top) == {"BotLikelihoodScore", "CarrierType", "amt"}
    assert bundle.importance.count() == len(bundle.features)


def test_bundle_round_trip_scores_equal(spark, data, bundle, tmp_path):
    path = str(tmp_path / "bundle")
    save_bundle(bundle, path)
    back = load_bundle(spark, path)
    assert back.features == bundle.features and set(back.categories) == set(bundle.categories) and back.threshold == bundle.threshold
    cols = ["trans_num", "FraudScore", "Decision"]
    a = bundle.score_and_decide(data[1]).select(*cols).orderBy("trans_num").collect()
    assert a == back.score_and_decide(data[1]).select(*cols).orderBy("trans_num").collect()
    nodes = importance.node_importance(spark, f"{path}/model/stages/0_{bundle.model.stages[0].uid}", bundle.features)
    by_nodes = {r["feature"] for r in nodes.where("split > 0").collect()}
    by_model = {r["feature"] for r in bundle.importance.where("gain_norm > 0").collect()}
    assert by_nodes == by_model and nodes.agg(F.sum("gain_norm")).first()[0] == pytest.approx(1)


def test_serving_matches_training_path(data, bundle):
    """A row with text numbers and without a column scores like its clean twin with nulls."""
    clean = data[1].limit(50).withColumn("CheckoutTimeSec", F.lit(None).cast("double"))
    rough = clean.drop("CheckoutTimeSec").withColumn("amt", F.col("amt").cast("string"))
    key = ["trans_num", "score"]
    assert bundle.score(clean).select(*key).orderBy("trans_num").collect() == bundle.score(rough).select(*key).orderBy("trans_num").collect()


def test_fixed_threshold_and_recall_floor(data, bundle):
    fixed = train(*data, {**PARAMS, "maxIter": 2}, threshold=0.42)
    assert fixed.threshold == 0.42
    low = train(*data, {**PARAMS, "maxIter": 2}, min_recall=0.99)
    assert low.threshold <= fixed.threshold or low.pr_auc > 0


def test_attribution(data, bundle):
    coded = encode.apply_encoders(data[1], bundle.encoders, bundle.categories)
    inputs = encode.numeric_inputs(coded, bundle.features)
    out = importance.permutation_importance(inputs, bundle.model, bundle.features, 400, assess=["amt", "DayOfWeek", "BotLikelihoodScore"])
    got = {r["feature"]: r for r in out.collect()}
    assert got["amt"]["effect"] > got["DayOfWeek"]["effect"] and got["amt"]["ap_drop"] > 0.05
    merged = importance.merge_importance(bundle.importance, out)
    assert merged.where("effect IS NULL").count() == len(bundle.features) - 3
    assert importance.merge_importance(bundle.importance, None).where("effect IS NOT NULL").isEmpty()
    curve = importance.learning_curve(bundle.model.stages[-1], prepare(coded.withColumn("is_fraud", F.col("is_fraud").cast("double")), bundle.features))
    losses = [r["loss"] for r in curve.orderBy("round").collect()]
    assert losses[-1] < losses[0] and curve.where("is_best").count() == 1


def test_search_draws_are_seeded_and_override_only_sampled(data, bundle):
    assert random_params(5, 1) == random_params(5, 1) != random_params(5, 2)
    assert all(0.01 <= p["stepSize"] <= 0.15 and 20 <= p["minInstancesPerNode"] <= 200 for p in random_params(50))
    coded = encode.apply_encoders(data[0], bundle.encoders, bundle.categories)
    ready = prepare(split.validation_flag(coded).select("trans_num", "is_fraud", "is_validation", *bundle.features), bundle.features)
    best, results = tune(ready, 5.0, trials=2, base={"maxIter": 2})
    assert len(results) == 2 and best["maxIter"] == 2 and max(ap for _, ap in results) > 0


def test_halving_keeps_the_better_third(data, bundle):
    from txnrisk.model.train import tune_halving

    coded = encode.apply_encoders(data[0], bundle.encoders, bundle.categories)
    ready = prepare(split.validation_flag(coded).select("trans_num", "is_fraud", "is_validation", *bundle.features), bundle.features)
    best, table = tune_halving(ready, 5.0, trials=7, rounds=1, factor=3, base={"subsamplingRate": 1.0})
    rungs = {}
    for rung, trial, rounds, ap, kept in table:
        assert rounds == 3**rung and 0 <= ap <= 1
        rungs.setdefault(rung, []).append((trial, ap, kept))
    assert [len(r) for r in rungs.values()] == [7, 3]
    for rung, rows in rungs.items():
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[: -(-len(rows) // 3)]
        assert {t for t, _, kept in rows if kept} == {t for t, _, _ in want}
        assert rung + 1 not in rungs or {t for t, *_ in rungs[rung + 1]} == {t for t, _, _ in want}
    (last,) = [t for t, _, kept in rungs[max(rungs)] if kept]
    assert best == {"subsamplingRate": 1.0, **random_params(7)[last]}


def test_ranges_of_categories_are_numbered_alike(spark, monkeypatch):
    from txnrisk.model import encode

    df = card_events(spark, SMALL).select("merchant", "cc_num", "MerchantCategory", "TransactionHour")
    columns = ["merchant", "cc_num", "MerchantCategory", "TransactionHour"]
    whole = encode.fit_encoders(df, columns).orderBy("column", "code").collect()
    monkeypatch.setattr(encode, "NUMBERED_ROWS", 7)
    assert encode.fit_encoders(df, columns).orderBy("column", "code").collect() == whole
    rows = encode.apply_encoders(df, encode.fit_encoders(df, columns), columns).collect()
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 300)  # some columns by broadcast, others by shuffle
    again = encode.apply_encoders(df, encode.fit_encoders(df, columns), columns).collect()
    assert sorted(again) == sorted(rows)


def _vectors(spark, n):
    df = spark.range(n).selectExpr("id AS trans_num", "CAST(id % 10 AS DOUBLE) AS a", "CAST(id % 3 = 0 AS DOUBLE) AS b", "CAST(id % 10 > 6 AS INT) AS is_fraud", "id % 5 = 0 AS is_validation")
    return learn.prepare(df, ["a", "b"])


def test_learners_get_partitions_by_rows(spark, monkeypatch):
    ready = _vectors(spark, 1_000).coalesce(2)
    with learn.learner_rows(ready, 4.0) as rows:
        assert rows.rdd.getNumPartitions() == 2  # rows that fit stay where they are
    monkeypatch.setattr(learn, "LEARNED_ROWS", 100)
    with learn.learner_rows(ready, 4.0) as rows:
        assert rows.rdd.getNumPartitions() == 10 and rows.storageLevel.useDisk
        got = sorted((r["features"].toArray().tolist(), r["is_fraud"], r["_weight"]) for r in rows.collect())
    assert got == sorted((r["features"].toArray().tolist(), r["is_fraud"], 4.0 if r["is_fraud"] == 1 else 1.0) for r in ready.collect())
    assert rows.storageLevel == StorageLevel.NONE


def test_vectors_are_unpacked(spark):
    ready = _vectors(spark, 20)
    want = {r["trans_num"]: (r["a"], r["b"]) for r in ready.collect()}
    again = learn.unpacked(ready.drop("a", "b"), ["a", "b"])
    assert {r["trans_num"]: (r["a"], r["b"]) for r in again.collect()} == want and "features" not in again.columns


def test_trials_read_stored_rows(spark):
    from txnrisk.queries import streams

    ready = streams._tuning_rows(spark, SMALL)
    assert set(ready.columns) == {"trans_num", "is_fraud", "is_validation", "features"}
    assert ready.inputFiles() and all("/tuning-" in f for f in ready.inputFiles())


def _same_trees(a, b):
    return a.toDebugString.split("\n", 1)[1] == b.toDebugString.split("\n", 1)[1]


def test_first_rounds_are_a_shorter_fit(spark, monkeypatch, tmp_path):
    ready = _vectors(spark, 1_000)
    settings = {"maxDepth": 3, "stepSize": 0.3, "minInstancesPerNode": 5, "seed": 7, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.7"}
    with learn.learner_rows(ready, 4.0) as rows:
        whole, short = learn._boost(rows, settings, 6, "is_fraud"), learn._boost(rows, settings, 3, "is_fraud")
    cut = learn.first_rounds(whole, 3)
    assert _same_trees(cut, short) and cut.treeWeights == short.treeWeights and cut.getOrDefault("maxIter") == 3
    assert cut.numFeatures == 2 and cut.getNumTrees == 3 and whole.getNumTrees == 6
    scored = [m.transform(ready.withColumn("_weight", F.lit(1.0))).orderBy("trans_num").select("probability").collect() for m in (cut, short)]
    assert scored[0] == scored[1]
    cut.write().save(str(tmp_path / "cut"))
    assert type(cut).load(str(tmp_path / "cut")).treeWeights == short.treeWeights
    # One fit is enough: the best model is not fitted again.
    fits, boost = [], learn._boost
    monkeypatch.setattr(learn, "_boost", lambda *a: (fits.append(a[2]), boost(*a))[1])
    losses = iter([[3.0, 1.0, 2.0, 4.0]])
    monkeypatch.setattr(learn.GBTClassificationModel, "evaluateEachIteration", lambda *a: next(losses))
    model, _ = learn.fit_rounds(ready, 4.0, {**settings, "maxIter": 4})
    assert fits == [4] and model.getNumTrees == 2


def test_precisions_of_many_models_in_one_plan(spark, monkeypatch):
    ready = _vectors(spark, 900)
    with learn.learner_rows(ready.where("NOT is_validation"), 2.0) as rows:
        models = [learn._boost(rows, {"maxDepth": d, "stepSize": 0.1, "seed": 3}, n, "is_fraud") for d, n in ((1, 1), (2, 1), (2, 3))]
    held_out = ready.where("is_validation")
    want = [learn.average_precision(learn.score(held_out, m)) for m in models]
    monkeypatch.setattr(learn, "SCORED_MODELS", 2)
    assert learn.average_precisions(held_out, models) == pytest.approx(want, abs=1e-12)
    assert learn.average_precisions(held_out.where("false"), models) == [0.0] * 3 and learn.average_precisions(held_out, []) == []
    calls = []
    monkeypatch.setattr(learn, "average_precisions", lambda h, m, label: (calls.append(len(m)), [0.5] * len(m))[1])
    learn.tune_halving(ready, 2.0, trials=4, rounds=1, base={"maxDepth": 2})
    assert calls == [4, 2]


def test_registered_search_is_the_whole_one(spark, monkeypatch):
    """All trials of the search, each to its best round: no smaller number of either."""
    from inspect import signature

    from txnrisk.queries import streams

    asked = {}

    def tune(ready, weight, *args, **kwargs):
        asked.update(signature(learn.tune).bind(ready, weight, *args, **kwargs).arguments)
        return {}, [({"stepSize": 0.1, "maxDepth": 5}, 0.5)]

    monkeypatch.setattr(streams, "tune", tune)
    monkeypatch.setattr(streams, "_tuning_rows", lambda *a: _vectors(spark, 50))
    assert streams.tuning(spark, SMALL).collect()[0]["pr_auc"] == 0.5
    trials = signature(learn.tune).parameters["trials"].default
    assert asked.get("trials", trials) == trials == 50 and not asked.get("base") and learn._settings(asked.get("base"))[1] == 2_000


def test_trials_are_fitted_to_their_best_round(spark, monkeypatch):
    ready, fits, boost = _vectors(spark, 400), [], learn._boost
    monkeypatch.setattr(learn, "_boost", lambda rows, settings, rounds, label: (fits.append(rounds), boost(rows, settings, min(rounds, 2), label))[1])
    losses = {100: [1.0 / (i + 1) for i in range(100)], 200: [abs(i - 110.0) for i in range(200)]}
    monkeypatch.setattr(learn.GBTClassificationModel, "evaluateEachIteration", lambda *a: losses[fits[-1]])
    monkeypatch.setattr(learn, "first_rounds", lambda model, rounds: (fits.append(("first", rounds)), model)[1])
    _, results = learn.tune(ready, 2.0, trials=1, base={"minInstancesPerNode": 5})
    assert fits == [100, 200, ("first", 111)] and len(results) == 1
