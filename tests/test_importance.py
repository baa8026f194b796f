"""Permutation effects against the model's own scores of swapped rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from txnrisk.functions import key_hash
from txnrisk.model import importance
from txnrisk.model import train as learn
from txnrisk.model.score import score
from txnrisk.queries import streams

FEATURES = ["a", "b", "c", "unused"]


def _rows(spark, n):
    cells = "id AS trans_num", "CAST(id * 7919 % 101 AS DOUBLE) AS a", "CAST(id * 104729 % 13 AS DOUBLE) AS b", "CAST(id % 7 AS DOUBLE) AS c", "1.0D AS unused"
    return spark.range(n).selectExpr(*cells).withColumn("is_fraud", F.expr("CAST(a + 3 * b + c * c > 80 AS DOUBLE)"))


@pytest.fixture(scope="module")
def model(spark):
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_rows(spark, 600))
    return PipelineModel([GBTClassifier(labelCol="is_fraud", maxIter=5, maxDepth=3, seed=1).fit(rows)])


def _brute_force(df, model, seed=42):
    """feature -> (effect, ap_drop) from the model's scores of every row with one column in another hash order."""
    assembler, rows = VectorAssembler(inputCols=FEATURES, outputCol="features"), df.orderBy(key_hash("trans_num", seed), "trans_num").collect()
    other = df.orderBy(key_hash("trans_num", seed + 1), "trans_num").collect()

    def scored(feature):
        swapped = [(i, r["is_fraud"], *[o[f] if f == feature else r[f] for f in FEATURES]) for i, (r, o) in enumerate(zip(rows, other, strict=True))]
        made = df.sparkSession.createDataFrame(swapped, ["i", "is_fraud", *FEATURES])
        found = score(assembler.transform(made), model).orderBy("i").collect()
        return np.array([r["score"] for r in found]), np.array([r["is_fraud"] for r in found])

    def precision(s, y):
        return sum(y[s == t].sum() * y[s >= t].mean() for t in set(s.tolist())) / y.sum()

    base, y = scored(None)
    out = {}
    for f in FEATURES:
        s, _ = scored(f)
        out[f] = (np.abs(s - base).mean(), precision(base.round(12), y) - precision(s.round(12), y))
    return out


def test_effect_of_all_rows(spark, model, monkeypatch):
    df = _rows(spark, 2_500)
    monkeypatch.setattr(importance, "HASH_SEGMENTS", 8)
    monkeypatch.setattr(importance, "ROWS", 300)
    want = _brute_force(df, model)
    got = {r["feature"]: (r["effect"], r["ap_drop"]) for r in importance.permutation_importance(df, model, FEATURES, None).collect()}
    assert got.keys() == want.keys() and got["unused"] == (0.0, 0.0)
    for f in FEATURES:
        assert got[f] == pytest.approx(want[f], abs=1e-9)
    effect = importance.permutation_importance(df, model, FEATURES, None, ap_drop=False)
    assert {r["feature"]: r["effect"] for r in effect.collect()} == pytest.approx({f: e for f, (e, _) in got.items()}) and effect.columns == ["feature", "effect"]


def test_rows_without_a_key_are_swapped_too(spark, model):
    df = _rows(spark, 300).withColumn("trans_num", F.when(F.col("trans_num") % 3 > 0, F.col("trans_num")))
    got = importance.permutation_importance(df, model, FEATURES, None).collect()
    assert len(got) == len(FEATURES) and all(0 <= r["effect"] < 1 for r in got)
    numbers = sorted(r["_at"] for r in importance._numbered(df, "trans_num", 1).collect())
    assert numbers == list(range(1, 301))
    assert importance.permutation_importance(df.where("false"), model, FEATURES, None).isEmpty()


def test_stored_effects_are_those_of_all_validation_rows(spark, monkeypatch):
    """The registered training job takes no sample of the validation rows."""
    asked = {}

    def train(early, late, params, **settings):
        asked.update(settings)
        raise InterruptedError

    monkeypatch.setattr(streams, "train", train)
    monkeypatch.setattr(streams, "_parts", lambda *a: (None, None, None))
    monkeypatch.setattr(streams, "_BUNDLES", {})
    with pytest.raises(InterruptedError):
        streams._trained(spark, "/root/testdata/sf0.001")
    assert asked["attribution_rows"] is None

    rows = _rows(spark, 3_000).withColumn("MerchantCategory", F.expr("concat('c_', CAST(trans_num % 3 AS STRING))"))
    seen = []
    plain = importance.permutation_importance
    monkeypatch.setattr(learn.importance, "permutation_importance", lambda df, *a, **k: (seen.append(df.count()), plain(df, *a, **k))[1])
    monkeypatch.setattr(importance, "seeded_sample", lambda *a, **k: pytest.fail("a sample was taken"))
    bundle = learn.train(rows.where("trans_num % 5 > 0"), rows.where("trans_num % 5 = 0"), {"maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 5}, val_frac=0.9, attribution_rows=None)
    assert seen[0] > 2_000 and bundle.importance.where("effect IS NULL").isEmpty()
