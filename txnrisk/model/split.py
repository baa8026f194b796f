"""Seeded, key-based splits and samples: the same rows on every run, at any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import key_hash
from txnrisk.plans.running import Running, carried_running
from txnrisk.plans.scalars import with_row

HASH_RANGE = 1 << 32
HASH_SEGMENTS = 4_096


def validation_flag(
    df: DataFrame, frac: float = 0.2, seed: int = 42, key: str = "trans_num", label: str = "is_fraud", exact: bool = False
) -> DataFrame:
    """Adds boolean ``is_validation``.

    By default a row is in validation when its key hash falls below the fraction: no shuffle, class rates kept
    in expectation. ``exact`` takes round(frac · n) rows of each class with the smallest hashes, which costs one
    shuffle over (class, hash range).
    """
    h = key_hash(key, seed)
    if not exact:
        return df.withColumn("is_validation", h < int(frac * HASH_RANGE))
    hashed = df.withColumn("_hash", h)
    order = [F.col("_hash"), F.col(key)]
    segment = F.floor(F.col("_hash") / (HASH_RANGE // HASH_SEGMENTS))
    history = hashed.select(label, "_hash", key)
    placed = carried_running(hashed, [label], segment, order, {"_position": Running("sum", F.lit(1))}, history=history)
    # One row per class, as one map: constant size.
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce(label, F.lit(-1)), "n"))).alias("_sizes"))
    wanted = F.round(F.element_at("_sizes", F.coalesce(label, F.lit(-1))) * frac)
    return with_row(placed, counts).withColumn("is_validation", F.col("_position") <= wanted).drop("_hash", "_position", "_sizes")


def stratified_split(df: DataFrame, frac: float = 0.2, seed: int = 42, **kwargs) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by ``validation_flag``."""
    flagged = validation_flag(df, frac, seed, **kwargs)
    return tuple(flagged.where(c).drop("is_validation") for c in (~F.col("is_validation"), F.col("is_validation")))


def class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row: n_neg, n_pos and the positive-class weight round(n_neg / n_pos, 2)."""
    counts = df.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos"))
    return counts.withColumn("scale_pos_weight", F.round(F.try_divide(F.col("n_neg"), F.col("n_pos")), 2))


def seeded_sample(
    df: DataFrame, n: int, seed: int = 42, key: str = "trans_num", by: str | None = None, groups: Sequence = (0, 1)
) -> DataFrame:
    """The n rows with the smallest key hash, or n of each listed group: top-k per partition, then merged."""

    def take(part: DataFrame) -> DataFrame:
        return part.orderBy(key_hash(key, seed), F.col(key)).limit(n)

    if by is None:
        return take(df)
    samples = [take(df.where(F.col(by) == g)) for g in groups]
    out = samples[0]
    for sample in samples[1:]:
        out = out.unionByName(sample)
    return out


def positive_weight(label: str, weight: float) -> Column:
    return F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))
