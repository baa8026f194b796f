"""Feature importance: impurity gain, split counts, permutation effect, learning curve."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions import key_hash, safe_ratio
from txnrisk.model import attribution
from txnrisk.model.split import HASH_RANGE, HASH_SEGMENTS, seeded_sample
from txnrisk.plans.ranked import ranked_totals
from txnrisk.plans.running import Running, carried_running
from txnrisk.plans.scalars import with_row
from txnrisk.session import materialise, run_folder

#: Rows that are scored at once.
ROWS = 1_000


def gain_importance(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """(feature, gain_norm), the learner's normalised impurity gain, zero ones included; one row per feature."""
    gains = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, gains, strict=True)), "feature string, gain_norm double")


def node_importance(spark: SparkSession, model_path: str, features: Sequence[str]) -> DataFrame:
    """(feature, gain, split, gain_norm, split_norm) from the tree nodes of a saved model: total gain and split counts."""
    nodes = spark.read.parquet(f"{model_path}/data").select("nodeData.*")
    used = (
        nodes.where("leftChild >= 0")
        .groupBy(F.col("split.featureIndex").alias("position"))
        .agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("split"))
    )
    names = spark.createDataFrame(list(enumerate(features)), "position int, feature string")
    out = names.join(used, "position", "left").fillna(0, ["gain", "split"])
    return with_row(out, used.agg(F.sum("gain").alias("_gain"), F.sum("split").alias("_split"))).select(
        "feature",
        "gain",
        "split",
        F.coalesce(F.try_divide("gain", "_gain"), F.lit(0.0)).alias("gain_norm"),
        F.coalesce(F.try_divide("split", "_split"), F.lit(0.0)).alias("split_norm"),
    )


def top_importance(importance: DataFrame, n: int = 20, by: str = "gain_norm") -> DataFrame:
    return importance.orderBy(F.desc(by), F.asc("feature")).limit(n)


def zero_importance(importance: DataFrame, by: str = "gain_norm") -> DataFrame:
    return importance.where(F.col(by) == 0).select("feature")


def merge_importance(gain: DataFrame, effect: DataFrame | None, name: str = "effect") -> DataFrame:
    """Attribution next to gain; the column exists, null, when there is no attribution."""
    if effect is None:
        return gain.withColumn(name, F.lit(None).cast("double"))
    return gain.join(effect.select("feature", name), "feature", "left")


class Tree(NamedTuple):
    """Nodes as arrays, the root first; a leaf leads to itself. ``feature`` is a place in ``reads``, the features that the tree splits on."""

    reads: list[int]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int


def _tree(nodes: dict[int, tuple], weight: float) -> Tree:
    at = {n: i for i, n in enumerate(sorted(nodes))}
    reads = sorted({f for f, *_ in nodes.values() if f >= 0})
    place = {-1: 0, **{f: i for i, f in enumerate(reads)}}
    cells = [(place[f], t if f >= 0 else np.inf, at.get(low, i), at.get(high, i), weight * v) for i, (f, t, low, high, v, _) in enumerate(nodes[n] for n in at)]
    depth, level = 0, [0]
    while level := [c for n in level for c in nodes[n][2:4] if c >= 0]:
        depth += 1
    return Tree(reads, *[np.array(c) for c in zip(*cells, strict=True)], depth)


def _values(tree: Tree, x: Mapping[int, np.ndarray], n: int) -> np.ndarray:
    """Weighted output of a tree for n rows with columns ``x``."""
    at, row = np.zeros(n, dtype=np.int64), np.arange(n)
    own = np.stack([x[f] for f in tree.reads], axis=1) if tree.depth else None
    for _ in range(tree.depth):
        at = np.where(own[row, tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
    return tree.value[at]


def _swapped_scores(trees: Sequence[Tree], x: Mapping[int, np.ndarray], other: Mapping[int, np.ndarray], n: int) -> list[np.ndarray]:
    """The score of n rows, and their score with each column of ``other`` in its place; only trees that read the column are asked again."""

    def score_of(values: np.ndarray) -> np.ndarray:
        return 1 - 1 / (1 + np.exp(2 * values.sum(axis=1)))

    own = np.empty((n, len(trees)))
    for k, tree in enumerate(trees):
        own[:, k] = _values(tree, x, n)
    out = [score_of(own)]
    for f, column in other.items():
        changed = own.copy()
        for k, tree in enumerate(trees):
            if f in tree.reads:
                changed[:, k] = _values(tree, {**x, f: column}, n)
        out.append(score_of(changed))
    return out


def _numbered(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with ``_at``, their number 1.. in the order of the key's hash; no task holds more than one of HASH_SEGMENTS ranges of it."""
    h = F.coalesce(key_hash(key, seed), F.lit(-1))
    place = F.floor(h / (HASH_RANGE // HASH_SEGMENTS))
    return carried_running(df, [], place, [h, F.col(key)], {"_at": Running("sum", F.lit(1))}, history=df.select(key))


def permutation_importance(
    df: DataFrame,
    model,
    features: Sequence[str],
    n: int | None = 5_000,
    seed: int = 42,
    key: str = "trans_num",
    label: str = "is_fraud",
    assess: Sequence[str] | None = None,
    ap_drop: bool = True,
) -> DataFrame:
    """(feature, effect, ap_drop) on all rows (n is None) or a key-hash sample of n rows with numeric features.

    One column at a time is replaced by its values in another hash order. ``effect`` is the mean absolute
    change of the score, ``ap_drop`` the loss of average precision (left out without the flag). A feature that no tree reads
    changes no score: both are 0. The others are swapped in the trees that read them, whose nodes are sent to every task.
    """
    assess = list(assess or features)
    spark, stage = df.sparkSession, model.stages[-1]
    folder = run_folder(spark, "trees")
    stage.write().save(folder)
    trees = [_tree(nodes, stage.treeWeights[at]) for at, nodes in attribution.model_trees(spark, folder)]
    read = sorted({f for tree in trees for f in tree.reads})
    swapped = {f: features[f] for f in read if features[f] in assess}

    rows = df.select(key, label, *[F.col(features[f]).cast("double").alias(f"_x{f}") for f in read])
    rows = materialise(rows if n is None else seeded_sample(rows, n, seed, key), "sample")
    other = _numbered(rows.select(key, *[f"_x{f}" for f in swapped]), key, seed + 1)
    other = other.select("_at", *[F.col(f"_x{f}").alias(f"_o{f}") for f in swapped])
    pairs = _numbered(rows, key, seed).join(other, "_at").drop("_at", key)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, ROWS) for a in range(0, batch.num_rows, ROWS)):
                x, y = ({f: part.column(f"_{c}{f}").to_numpy(zero_copy_only=False) for f in which} for c, which in (("x", read), ("o", swapped)))
                found = np.stack(_swapped_scores(trees, x, y, part.num_rows), axis=1)
                lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1], found.ravel())
                yield pa.RecordBatch.from_arrays([part.column(label), lists], names=[label, "_s"])

    schema = T.StructType([rows.schema[label], T.StructField("_s", T.ArrayType(T.DoubleType()))])
    scored = pairs.mapInArrow(scores, schema)
    if ap_drop:
        scored = materialise(scored, "variants")

    means = [F.struct(F.lit(c).alias("feature"), F.avg(F.abs(F.col("_s")[i + 1] - F.col("_s")[0])).alias("effect")) for i, c in enumerate(swapped.values())]
    still = [F.struct(F.lit(c).alias("feature"), F.lit(0.0).alias("effect")) for c in assess if c not in swapped.values()]
    effects = scored.agg(F.count(F.lit(1)).alias("_n"), F.array(*means, *still).alias("_all")).where("_n > 0").select(F.inline("_all"))
    if not ap_drop:
        return effects.orderBy(F.desc("effect"), F.asc("feature"))
    sums = {"pos": (F.col(label) == 1).cast("int"), "neg": (F.col(label) == 0).cast("int")}
    levels = ranked_totals(scored.select(label, F.posexplode("_s").alias("_swapped", "_v")), "_v", sums, by=["_swapped"], descending=True)
    precision = safe_ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg"))
    ap = levels.groupBy("_swapped").agg(safe_ratio(F.sum(F.col("pos") * precision), F.sum("pos")).alias("ap"))
    # One number per swapped feature, the unchanged scores first.
    found = ap.agg(F.map_from_entries(F.collect_list(F.struct("_swapped", "ap"))).alias("_ap"))
    numbers = F.create_map(*[F.lit(v) for i, c in enumerate(swapped.values()) for v in (c, i + 1)]) if swapped else F.create_map().cast("map<string,int>")
    whole = F.try_element_at("_ap", F.lit(0))
    drop = whole - F.try_element_at("_ap", F.coalesce(F.try_element_at(numbers, "feature"), F.lit(0)))
    return with_row(effects, found).select("feature", "effect", drop.alias("ap_drop")).orderBy(F.desc("effect"), F.asc("feature"))


def curve_table(spark: SparkSession, losses: Sequence[float]) -> DataFrame:
    """(round, loss, is_best): validation loss after each boosting round, those after the best one too."""
    best = min(range(len(losses)), key=losses.__getitem__) if losses else -1
    return spark.createDataFrame([(i + 1, float(v), i == best) for i, v in enumerate(losses)], "round int, loss double, is_best boolean")


def learning_curve(model, validation: DataFrame) -> DataFrame:
    """The curve of a fitted model on other rows."""
    # The model asks for its weight column; validation loss is unweighted.
    return curve_table(validation.sparkSession, model.evaluateEachIteration(validation.withColumn("_weight", F.lit(1.0))))
