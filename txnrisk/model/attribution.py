"""Exact additive attribution of boosted trees, row by row.

A row's margin is the mean margin plus one value per feature: the Shapley values of the trees' path-dependent expectation, in which a feature that is
not given follows a split's children by their training rows. Every leaf is a game of its own among the few features on its path:
feature k either holds the row in (1) or not (0), and holds a share z_k of the training rows in when it is not given. The leaf's value for
feature j is v (o_j - z_j) times a sum over coalitions of the others, the coefficients of the product of (z_k + o_k y). It depends on the row
only through the bits o, so leaves with equally many features are handled together: a table over all bits, looked up for all rows of a batch.

The leaves are those of one model and are sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Leaves and rows that are handled at once.
LEAVES, ROWS = 128, 1_000


class Leaves(NamedTuple):
    """Leaves with equally many features on their path: bounds (low, high], training shares, margins."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def path_leaves(nodes: dict[int, tuple], weight: float) -> Iterator[tuple[list[int], list[float], list[float], list[float], float]]:
    """Leaves of a tree of nodes id -> (feature or -1, threshold, left, right, prediction, training rows)."""
    stack = [(0, {})]
    while stack:
        at, path = stack.pop()
        feature, threshold, left, right, prediction, rows = nodes[at]
        if feature < 0:
            bounds = list(path.values())
            yield list(path), [b[0] for b in bounds], [b[1] for b in bounds], [b[2] for b in bounds], weight * prediction
            continue
        low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
        stack.append((left, {**path, feature: (low, min(high, threshold), share * nodes[left][5] / rows)}))
        stack.append((right, {**path, feature: (max(low, threshold), high, share * nodes[right][5] / rows)}))


def grouped(leaves: Iterator[tuple]) -> dict[int, Leaves]:
    by_size: dict[int, list] = {}
    for leaf in leaves:
        by_size.setdefault(len(leaf[0]), []).append(leaf)
    return {d: Leaves(*(np.array([leaf[i] for leaf in own]) for i in range(5))) for d, own in sorted(by_size.items())}


def model_trees(spark: SparkSession, path: str) -> list[tuple[int, dict[int, tuple]]]:
    """(position, nodes) of every tree of a saved ensemble with numeric splits; as many rows as the model has nodes pass through the driver."""
    cells = "treeID", "nodeData.id", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold", "nodeData.leftChild", "nodeData.rightChild"
    stored = spark.read.parquet(f"{path}/data").select(*cells, "nodeData.prediction", F.col("nodeData.rawCount").cast("double"), "nodeData.split.numCategories")
    trees: dict[int, dict[int, tuple]] = {}
    for tree, at, feature, threshold, left, right, prediction, rows, categories in stored.collect():
        if left >= 0 and categories >= 0:
            raise ValueError("splits by category sets are not supported")
        trees.setdefault(tree, {})[at] = (feature, threshold[0], left, right, prediction, rows) if left >= 0 else (-1, 0.0, -1, -1, prediction, rows)
    return sorted(trees.items())


def model_leaves(spark: SparkSession, path: str, weights: Sequence[float]) -> dict[int, Leaves]:
    """The leaves of a saved ensemble."""
    return grouped(leaf for tree, nodes in model_trees(spark, path) for leaf in path_leaves(nodes, weights[tree]))


def mean_margin(groups: dict[int, Leaves]) -> float:
    return float(sum((g.value * g.share.prod(axis=1)).sum() if d else g.value.sum() for d, g in groups.items()))


def _tables(share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Values of every feature of every leaf for all combinations of bits: (leaves, 2^d, d)."""
    n, d = share.shape
    bits = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    out = np.empty((n, 1 << d, d))
    sizes = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
    for j in range(d):
        coefficients = np.zeros((n, 1 << d, d))
        coefficients[:, :, 0] = 1
        for k in range(d):
            if k != j:
                held = coefficients * share[:, k, None, None]
                held[:, :, 1:] += coefficients[:, :, :-1] * bits[None, :, k, None]
                coefficients = held
        out[:, :, j] = value[:, None] * (bits[None, :, j] - share[:, j, None]) * (coefficients @ sizes)
    return out


def attribute(x: np.ndarray, groups: dict[int, Leaves]) -> np.ndarray:
    """Values of all features for all rows."""
    n, p = x.shape
    out = np.zeros(n * p)
    for d, group in groups.items():
        for a in range(0, len(group.value) if d else 0, LEAVES):
            features, low, high, share, value = (c[a : a + LEAVES] for c in group)
            table = _tables(share, value)
            leaf = np.arange(len(value))[None, :]
            for r in range(0, n, ROWS):
                own = x[r : r + ROWS][:, features]
                pattern = ((own > low) & (own <= high)) @ (1 << np.arange(d))
                place = (np.arange(r, r + len(own))[:, None, None] * p + features[None]).ravel()
                out += np.bincount(place, weights=table[leaf, pattern].ravel(), minlength=n * p)
    return out.reshape(n, p)


def row_attribution(df: DataFrame, groups: dict[int, Leaves], features: Sequence[str], key: str = "trans_num") -> DataFrame:
    """(key, base, values) of every row: ``base`` plus the values, in feature order, is the row's margin.

    Expects the model's inputs: encoded categories, numbers without nulls. An empty table gives an empty result.
    """
    features, base = list(features), mean_margin(groups)
    schema = T.StructType([df.schema[key], T.StructField("base", T.DoubleType()), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features], axis=1) if n else np.zeros((0, len(features)))
            found = attribute(x, groups)
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(features), found.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.full(n, base)), lists], names=schema.fieldNames())

    return df.select(key, *[F.col(f).cast("double").alias(f) for f in features]).mapInArrow(values, schema)


def attribution_importance(attributed: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean_abs, mean): size and direction of each feature's values over the rows, largest first."""
    cells = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("values").alias("value"))
    rows = attributed.select(F.inline(cells))
    means = rows.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"))
    return means.orderBy(F.desc("mean_abs"), F.asc("feature"))
