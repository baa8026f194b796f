"""Boosted-tree training, tuning and the end-to-end training job, all on Spark ML."""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import SparkContext, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import safe_ratio
from txnrisk.model import curves, encode, evaluate, importance, split
from txnrisk.model.bundle import Bundle
from txnrisk.model.score import score
from txnrisk.operators.asof import Profiles
from txnrisk.plans.ranked import ranked_totals
from txnrisk.session import ensure_checkpoint_dir, materialise

VECTOR = "features"

# Fixed values where the learner has the parameter; the validation rows choose the number of rounds.
DEFAULT_PARAMS: dict[str, Any] = {
    "maxIter": 2000,
    "stepSize": 0.05,
    "maxDepth": 7,
    "minInstancesPerNode": 100,
    "subsamplingRate": 0.7,
    "featureSubsetStrategy": "0.7",
    "seed": 42,
}

# Fixed values: (low, high) of the searched parameters.
SEARCH_SPACE = {
    "stepSize": (0.01, 0.15),
    "maxDepth": (5, 8),
    "minInstancesPerNode": (20, 200),
    "featureSubsetStrategy": (0.5, 1.0),
    "subsamplingRate": (0.5, 1.0),
}


def prepare(df: DataFrame, features: Sequence[str], label: str = "is_fraud") -> DataFrame:
    """Rows with the feature vector, ready for a learner; expects encoded categories."""
    inputs = encode.numeric_inputs(df, features)
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR).transform(inputs).withColumn(label, inputs[label].cast("double"))


def unpacked(ready: DataFrame, features: Sequence[str]) -> DataFrame:
    """Prepared rows with one column per feature again instead of the vector."""
    rest = [c for c in ready.columns if c != VECTOR]
    return ready.select(*rest, vector_to_array(VECTOR).alias("_x")).select(*rest, *[F.col("_x")[i].alias(f) for i, f in enumerate(features)])


# Rows of one partition that a learner reads. It holds a partition's rows as objects and passes over them at every level of every tree.
LEARNED_ROWS = 200_000


@contextmanager
def learner_rows(learned: DataFrame, weight: float, label: str = "is_fraud") -> Iterator[DataFrame]:
    """Rows for a learner, positives weighing ``weight``: cut into partitions of LEARNED_ROWS at most on average, and held while fits read them.

    A stored table is dealt by bytes, and prepared rows take few of them: without the cut a partition grows with the table. Rows that fit
    their partitions stay where they are. What an executor loses is read again.
    """
    rows = learned.select(VECTOR, label, split.positive_weight(label, weight).alias("_weight"))
    parts = -(-learned.count() // LEARNED_ROWS)
    if parts > rows.rdd.getNumPartitions():
        rows = rows.repartition(parts, F.xxhash64(VECTOR))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def _boost(rows: DataFrame, settings: Mapping[str, Any], rounds: int, label: str) -> GBTClassificationModel:
    # Trees are shallow: walking down to a row's node costs less than keeping the node of every row after every level.
    learner = GBTClassifier(
        featuresCol=VECTOR, labelCol=label, weightCol="_weight", cacheNodeIds=False, checkpointInterval=20, maxIter=rounds, **settings
    )
    return learner.fit(rows)


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    """The model after its first rounds: the trees that a fit of so many rounds with the same seed would give."""
    java, sc = model._java_obj, SparkContext._active_spark_context
    trees, weights = java.trees(), model.treeWeights
    kept = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    kept_weights = sc._gateway.new_array(sc._gateway.jvm.double, rounds)
    for i in range(rounds):
        kept[i], kept_weights[i] = trees[i], float(weights[i])
    short = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), kept, kept_weights, model.numFeatures, model.numClasses)
    params = sc._jvm.org.apache.spark.ml.param.ParamMap()
    params.put(sc._jvm.PythonUtils.toSeq([java.maxIter().w(rounds)]))
    out = model._copyValues(GBTClassificationModel(java.copyValues(short, params)))
    return out._set(maxIter=rounds)


def _settings(params: Mapping[str, Any] | None) -> tuple[dict[str, Any], int]:
    """(parameters of a learner, most rounds)."""
    settings = {**DEFAULT_PARAMS, **(params or {})}
    settings.pop("validationTol", None)
    return settings, settings.pop("maxIter")


# Rounds without a better validation loss after which boosting stops, and rounds of the first fit.
PATIENCE = 50
FIRST_ROUNDS = 100


def fit_rounds(
    flagged: DataFrame, weight: float, params: Mapping[str, Any] | None = None, label: str = "is_fraud", patience: int = PATIENCE
) -> tuple[GBTClassificationModel, list[float]]:
    """(model of the best round, validation loss after every fitted round).

    Rows have ``features`` and ``is_validation``; positives weigh ``weight``. Boosting runs on the other rows until ``patience``
    rounds have brought no smaller validation loss or ``maxIter`` rounds are done; the number of rounds doubles until then. The
    best model has the trees up to the best round. Without validation rows all rounds count.
    """
    with learner_rows(flagged.where("NOT is_validation"), weight, label) as rows:
        return _fit_rows(rows, flagged.where("is_validation"), params, label, patience)


def _fit_rows(
    rows: DataFrame, held_out: DataFrame, params: Mapping[str, Any] | None, label: str, patience: int = PATIENCE
) -> tuple[GBTClassificationModel, list[float]]:
    """``fit_rounds`` on the rows of a learner."""
    settings, most = _settings(params)
    held_out = held_out.withColumn("_weight", F.lit(1.0))
    rounds = min(most, max(FIRST_ROUNDS, 2 * patience))
    if held_out.isEmpty():
        return _boost(rows, settings, most, label), []
    while True:
        model = _boost(rows, settings, rounds, label)
        losses = list(model.evaluateEachIteration(held_out))
        best = min(range(len(losses)), key=losses.__getitem__) + 1
        if best + patience <= rounds or rounds == most:
            return (model if best == rounds else first_rounds(model, best)), losses
        rounds = min(most, 2 * rounds)


def fit(flagged: DataFrame, weight: float, params: Mapping[str, Any] | None = None, label: str = "is_fraud") -> GBTClassificationModel:
    """The model of the best round."""
    return fit_rounds(flagged, weight, params, label)[0]


def random_params(n: int, seed: int = 42) -> list[dict[str, Any]]:
    """n seeded draws from the search space; the step size is log-uniform."""
    rng = random.Random(seed)
    draws = []
    for _ in range(n):
        low, high = SEARCH_SPACE["stepSize"]
        draws.append(
            {
                "stepSize": low * (high / low) ** rng.random(),
                "maxDepth": rng.randint(*SEARCH_SPACE["maxDepth"]),
                "minInstancesPerNode": rng.randint(*SEARCH_SPACE["minInstancesPerNode"]),
                "featureSubsetStrategy": f"{rng.uniform(*SEARCH_SPACE['featureSubsetStrategy']):.3f}",
                "subsamplingRate": rng.uniform(*SEARCH_SPACE["subsamplingRate"]),
            }
        )
    return draws


def stored_scores(scored: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Score and label in a table of their own: curves and counts read it several times, the model runs once."""
    return materialise(scored.select("score", label), "scores")


#: Models that one pass over the validation rows scores.
SCORED_MODELS = 10


def average_precision(scored: DataFrame, label: str = "is_fraud") -> float:
    return curves.areas(curves.score_levels(stored_scores(scored, label), "score", label)).first()["pr_auc"] or 0.0


def average_precisions(held_out: DataFrame, models: Sequence[GBTClassificationModel], label: str = "is_fraud") -> list[float]:
    """``average_precision`` of every model's scores of the same rows: the rows are read once for SCORED_MODELS of them, all curves come from one plan."""
    if not models:
        return []
    stored = []
    for a in range(0, len(models), SCORED_MODELS):
        out, some = held_out.select(VECTOR, label), range(a, min(a + SCORED_MODELS, len(models)))
        for i in some:
            out = score(out, models[i], f"_s{i}")
        cells = F.array(*[F.struct(F.lit(i).alias("model"), F.col(f"_s{i}").alias("score")) for i in some])
        stored.append(materialise(out.select(label, F.inline(cells)), "scores"))
    sums = {"pos": F.when(F.col(label) == 1, 1).otherwise(0), "neg": F.when(F.col(label) == 0, 1).otherwise(0)}
    levels = ranked_totals(reduce(DataFrame.unionByName, stored), "score", sums, by=["model"], descending=True)
    precision = safe_ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg"))
    found = levels.groupBy("model").agg(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("ap")).collect()
    precisions = {r["model"]: r["ap"] for r in found}
    return [precisions.get(i) or 0.0 for i in range(len(models))]


def tune(
    flagged: DataFrame,
    weight: float,
    trials: int = 50,
    seed: int = 42,
    base: Mapping[str, Any] | None = None,
    label: str = "is_fraud",
    parallelism: int = 4,
) -> tuple[dict[str, Any], list[tuple[dict[str, Any], float]]]:
    """Best of ``trials`` random settings by exact average precision on the validation rows, and all results.

    Sampled parameters override the base ones; everything else keeps its value. Every trial is fitted to its best round, ``parallelism`` of them
    at a time; one model a thread is in memory.
    """
    held_out = flagged.where("is_validation")
    # All trials learn from the same rows.
    with learner_rows(flagged.where("NOT is_validation"), weight, label) as rows, ThreadPool(parallelism) as pool:

        def precision(draw: dict[str, Any]) -> tuple[dict[str, Any], float]:
            params = {**(base or {}), **draw}
            model, _ = _fit_rows(rows, held_out, params, label)
            return params, average_precision(score(held_out, model), label)

        results = pool.map(precision, random_params(trials, seed), chunksize=1)
    return max(results, key=lambda r: r[1])[0], results


def tune_halving(
    flagged: DataFrame,
    weight: float,
    trials: int = 50,
    rounds: int = 2,
    factor: int = 3,
    seed: int = 42,
    base: Mapping[str, Any] | None = None,
    label: str = "is_fraud",
    parallelism: int = 4,
) -> tuple[dict[str, Any], list[tuple[int, int, int, float, bool]]]:
    """Best of ``trials`` random settings by successive halving, and (rung, trial, rounds, average precision, kept) of every fit.

    All settings are fitted with few rounds of boosting; the better 1 / ``factor`` of them (rounded up) go on with ``factor`` times as many, until one
    is left. Settings are those of ``random_params``; equal precisions keep the earlier trial. Fits of a rung run ``parallelism`` at a time; their
    models are scored together.
    """
    learned, held_out = flagged.where("NOT is_validation"), flagged.where("is_validation")
    draws, left, rung, table = random_params(trials, seed), list(range(trials)), 0, []

    # Every fit learns from the same rows and all of them: no validation rows among them, so no early stop.
    with learner_rows(learned, weight, label) as rows:

        def fitted(trial: int) -> GBTClassificationModel:
            settings, most = _settings({**(base or {}), **draws[trial], "maxIter": rounds * factor**rung})
            return _boost(rows, settings, most, label)

        while left:
            with ThreadPool(parallelism) as pool:
                models = pool.map(fitted, left, chunksize=1)
            found = dict(zip(left, average_precisions(held_out, models, label), strict=True))
            best = sorted(left, key=lambda t: (-found[t], t))[: -(-len(left) // factor)]
            table += [(rung, t, rounds * factor**rung, found[t], t in best) for t in left]
            if len(best) == 1:
                break
            left, rung = sorted(best), rung + 1
    return ({**(base or {}), **draws[best[0]]} if trials else dict(base or {})), table


def train(
    train_rows: DataFrame,
    holdout: DataFrame,
    params: Mapping[str, Any] | None = None,
    trials: int = 0,
    threshold: float | None = None,
    min_recall: float | None = None,
    val_frac: float = 0.2,
    seed: int = 42,
    label: str = "is_fraud",
    key: str = "trans_num",
    attribution_rows: int | None = 0,
    scales: Mapping[str, float] | None = None,
    profiles: Profiles | None = None,
) -> Bundle:
    """Encode, split, weigh, (tune,) fit, pick the threshold on validation rows, evaluate on the holdout.

    With ``attribution_rows`` the permutation effect of every feature is measured on a sample of so many validation rows, on all of them with None.
    ``scales`` are the fitted divisors of the composite risk score, ``profiles`` all fitted statistics that the rows' features were made
    with (scales included); the bundle keeps them for serving.

    The dictionary and the prepared rows are written once to the shared folder: boosting reads them every round,
    and a lost executor must not replay the preparation.
    """
    spark = train_rows.sparkSession
    ensure_checkpoint_dir(spark)
    categories = [c for c in encode.CATEGORIES if c in train_rows.columns]
    encoders = materialise(encode.fit_encoders(train_rows, categories), "encoders")
    features = encode.feature_columns(train_rows.schema, categories, exclude=(*encode.KEY_COLUMNS, *encode.GEO_COLUMNS, key, label))
    coded = encode.apply_encoders(train_rows.where(train_rows[label].isNotNull()), encoders, categories)
    flagged = split.validation_flag(coded, val_frac, seed, key, label)
    prepared = prepare(flagged.select(key, label, "is_validation", *features), features, label)
    ready = materialise(prepared.select(key, label, "is_validation", VECTOR), "prepared")

    weight = split.class_weight(ready.where("NOT is_validation"), label).first()["scale_pos_weight"] or 1.0
    chosen = dict(params or {})
    if trials:
        chosen, _ = tune(ready, weight, trials, seed, chosen, label)
    model, losses = fit_rounds(ready, weight, chosen, label)

    if threshold is None:
        held_out = stored_scores(score(ready.where("is_validation"), model), label)
        levels = curves.score_levels(held_out, "score", label)
        threshold = float(curves.best_threshold(curves.pr_curve(levels), min_recall).first()["threshold"])
    bundle = Bundle(PipelineModel([model]), encoders, features, categories, threshold, None, None, None)
    scored = stored_scores(bundle.score(holdout), label)
    evaluation = materialise(evaluate.evaluate(scored, threshold, "score", label), "evaluation")
    gains = importance.gain_importance(spark, model, features)
    if attribution_rows != 0:
        held_out = unpacked(ready.where("is_validation"), features)
        # The bundle stores the effect alone.
        effect = materialise(importance.permutation_importance(held_out, bundle.model, features, attribution_rows, seed, key, label, ap_drop=False), "effect")
        gains = importance.merge_importance(gains, effect)
    return bundle._replace(
        pr_auc=evaluation.first()["pr_auc"],
        report=evaluate.report(evaluation),
        importance=gains,
        curve=importance.curve_table(spark, losses),
        scales=dict(profiles.scales) if profiles else dict(scales) if scales else None,
        profiles=profiles,
    )
