"""Curves, thresholds and quantiles against brute force, also when cut into buckets."""

import random

import numpy as np
import pytest

from tests import sample
from txnrisk.model import curves, evaluate
from txnrisk.operators import quality
from txnrisk.plans.ranked import bucket_of, exact_quantiles, value_splits

CUTS = [None, [], [0.1, 0.25, 0.5], [i / 50 for i in range(50)]]


def _scores(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [(i, round(rng.random() ** 2, 2), int(rng.random() < 0.3)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "trans_num long, score double, is_fraud int")


@pytest.mark.parametrize("cuts", CUTS)
def test_areas(spark, cuts):
    rows, df = _scores(spark)
    got = curves.areas(curves.score_levels(df, splits=cuts)).first()
    scores, labels = [r[1] for r in rows], [r[2] for r in rows]
    assert got["pr_auc"] == pytest.approx(sample.average_precision(scores, labels), abs=1e-12)
    assert got["roc_auc"] == pytest.approx(sample.roc_auc(scores, labels), abs=1e-12)


@pytest.mark.parametrize("cuts", CUTS[1:])
def test_curve_points_and_monotone_recall(spark, cuts):
    rows, df = _scores(spark)
    curve = curves.pr_curve(curves.score_levels(df, splits=cuts)).orderBy("threshold").collect()
    total = sum(r[2] for r in rows)
    for point in curve:
        hit = [r[2] for r in rows if r[1] >= point["threshold"]]
        assert point["precision"] == pytest.approx(sum(hit) / len(hit)) and point["recall"] == pytest.approx(sum(hit) / total)
    recalls = [p["recall"] for p in curve]
    assert recalls == sorted(recalls, reverse=True) and recalls[0] == 1.0


def test_best_threshold_ties_and_floor(spark):
    curve = spark.createDataFrame(
        [(0.2, 0.5, 1.0, 0.6), (0.4, 0.7, 0.7, 0.7), (0.6, 0.7, 0.7, 0.7), (0.8, 0.9, 0.1, 0.2)],
        "threshold double, precision double, recall double, f1 double",
    )
    assert curves.best_threshold(curve).first()["threshold"] == 0.4
    assert curves.best_threshold(curve, 0.9).first()["threshold"] == 0.2
    assert curves.best_threshold(curve.where("recall < 0.9"), 0.9).first()["threshold"] == 0.4


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, is_fraud int")
    row = evaluate.confusion(df, 0.5).first()
    assert (row["precision"], row["recall"], row["f1"], row["tn"]) == (0.0, 0.0, 0.0, 2)


@pytest.mark.parametrize("cuts", [None, [], [0.05, 0.3, 0.31, 0.9]])
def test_exact_quantiles(spark, cuts):
    rows, df = _scores(spark, 333)
    shares = {"q01": 0.01, "q50": 0.5, "q95": 0.95, "q100": 1.0}
    got = {r["is_fraud"]: r for r in exact_quantiles(df, "score", shares, ["is_fraud"], cuts).collect()}
    for label in (0, 1):
        values = [r[1] for r in rows if r[2] == label]
        for name, share in shares.items():
            assert got[label][name] == pytest.approx(np.quantile(values, share), abs=1e-12)


def test_bucket_lookup(spark):
    splits = [i / 10 for i in range(1, 10)]
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.1, 0.15, 0.5, 0.9, 0.95, 7.0)], "v double")
    got = [r[0] for r in df.select(bucket_of("v", splits)).collect()]
    assert got == [0, 0, 1, 4, 8, 9, 9]


def test_splits_balance(spark):
    df = spark.range(10_000).selectExpr("pow(id / 10000, 8) AS v")
    splits = value_splits(df, "v", rows_per_bucket=1_000)
    counts = [r["count"] for r in df.groupBy(bucket_of("v", splits)).count().collect()]
    assert len(splits) == 9 and max(counts) < 1_200


def test_winsorise(spark):
    _, df = _scores(spark, 200)
    values = np.array([r["score"] for r in df.collect()])
    got = sorted(r["score"] for r in quality.winsorise(df, "score", 0.05, 0.9).collect())
    assert got == pytest.approx(sorted(np.clip(values, np.quantile(values, 0.05), np.quantile(values, 0.9))))
