"""Row attribution against the definition of Shapley values."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import SMALL
from txnrisk.model import attribution as A
from txnrisk.queries import streams
from txnrisk.queries.inputs import card_events

FEATURES = ["amt", "IPRiskScore", "BotLikelihoodScore", "IsVPN", "cc_num", "PhoneRiskScore"]


def expectation(nodes, x, given, at=0):
    """Margin of a tree when only some features are given."""
    feature, threshold, left, right, prediction, rows = nodes[at]
    if feature < 0:
        return prediction
    if feature in given:
        return expectation(nodes, x, given, left if x[feature] <= threshold else right)
    return sum(nodes[c][5] / rows * expectation(nodes, x, given, c) for c in (left, right))


def shapley(nodes, x, p):
    out = np.zeros(p)
    for j in range(p):
        others = [k for k in range(p) if k != j]
        for size in range(p):
            for s in combinations(others, size):
                weight = factorial(size) * factorial(p - 1 - size) / factorial(p)
                out[j] += weight * (expectation(nodes, x, {*s, j}) - expectation(nodes, x, set(s)))
    return out


def random_tree(rng, p, depth):
    nodes = {}

    def grow(at, rows, level):
        if level == depth or rows < 4 or rng.random() < 0.15:
            nodes[at] = (-1, 0.0, -1, -1, float(rng.normal()), rows)
            return
        left = int(rng.integers(1, rows))
        nodes[at] = (int(rng.integers(p)), float(rng.random()), 2 * at + 1, 2 * at + 2, 0.0, rows)
        grow(2 * at + 1, left, level + 1)
        grow(2 * at + 2, rows - left, level + 1)

    grow(0, 1_000, 0)
    return nodes


@pytest.mark.parametrize(("p", "depth"), [(2, 4), (5, 5), (8, 6)])
def test_equals_all_subsets(p, depth):
    rng = np.random.default_rng(p)
    trees, weights, x = [random_tree(rng, p, depth) for _ in range(3)], [1.0, 0.1, 0.3], rng.random((4, p))
    groups = A.grouped(leaf for t, w in zip(trees, weights, strict=True) for leaf in A.path_leaves(t, w))
    got = A.attribute(x, groups)
    want = np.array([sum(w * shapley(t, row, p) for t, w in zip(trees, weights, strict=True)) for row in x])
    assert np.allclose(got, want, atol=1e-10)
    assert np.isclose(A.mean_margin(groups), sum(w * expectation(t, x[0], set()) for t, w in zip(trees, weights, strict=True)))


def test_values_add_up_to_the_margin(spark, tmp_path):
    df = card_events(spark, SMALL).select("trans_num", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    df = df.withColumn("label", ((F.col("BotLikelihoodScore") > 0.6) | (F.col("amt") > 90)).cast("double")).fillna(0.0)
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=5, maxDepth=4, seed=1).fit(ready)
    model.write().save(str(tmp_path / "m"))
    groups = A.model_leaves(spark, str(tmp_path / "m"), model.treeWeights)
    out = A.row_attribution(df.repartition(3), groups, FEATURES)
    margins = model.transform(ready).select("trans_num", vector_to_array("rawPrediction")[1].alias("margin"))
    rows = out.join(margins, "trans_num").collect()
    assert len(rows) == df.count() and all(abs(r.base + sum(r["values"]) - r.margin) < 1e-9 for r in rows)
    top = A.attribution_importance(out, FEATURES).collect()
    assert {r.feature for r in top[:2]} == {"BotLikelihoodScore", "amt"} and len(top) == len(FEATURES)
    assert A.row_attribution(df.where("false"), groups, FEATURES).collect() == []


def test_queries_ask_for_the_model_once(spark, monkeypatch):
    """Every call counts the events' rows and loads the stored model anew."""
    late = spark.createDataFrame([(1, 0.5, 0.2), (2, 1.5, 0.9)], "trans_num int, amt double, score double")
    asked = []

    class Model:
        uid, treeWeights = "gbt", [1.0]

    class Stored:
        importance = spark.createDataFrame([("amt", 1.0)], "feature string, gain_norm double")
        encoders, categories, features, model = None, [], ["amt"], type("Stages", (), {"stages": [Model]})

        def score(self, df):
            return df

    def trained(spark, sf_dir):
        asked.append(sf_dir)
        return Stored(), "folder", late, late

    monkeypatch.setattr(streams, "_trained", trained)
    monkeypatch.setattr("txnrisk.model.encode.apply_encoders", lambda df, encoders, categories: df.withColumn("is_fraud", F.lit(0)))
    monkeypatch.setattr(A, "model_leaves", lambda spark, path, weights: path)
    monkeypatch.setattr(A, "row_attribution", lambda df, leaves, features: df.withColumn("leaves", F.lit(leaves)))
    assert streams.effect_curve(spark, "events").count() > 0 and len(asked) == 1
    values, _, _ = streams._attributed(spark, "events")
    assert {r.leaves for r in values.collect()} == {"folder/model/stages/0_gbt"} and len(asked) == 2
