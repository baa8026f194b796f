"""Pearson correlations over pairwise complete rows, all pairs in one scan."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.quality import LABEL, numeric_columns


def _correlations(df: DataFrame, pairs: Sequence[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    """(name, name, corr) per pair; null when either side is constant over the complete pairs.

    Rows unfold to one (pair, x, y) each and fold again on the map side, so the aggregate stays one small
    generated loop whatever the number of pairs, and only one buffer per pair is shuffled.
    """
    cells = [
        F.struct(F.lit(i).alias("position"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for i, (a, b) in enumerate(pairs)
    ]
    complete = df.select(F.inline(F.array(*cells))).where("x IS NOT NULL AND y IS NOT NULL")
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    found = complete.groupBy("position").agg(F.try_divide(F.covar_pop("x", "y"), spread).alias("corr"))
    # One entry per pair, so one row; a pair without any complete row still gets its line.
    table = found.agg(F.map_from_entries(F.collect_list(F.struct("position", "corr"))).alias("found"))
    listed = [F.struct(F.lit(i).alias("position"), F.lit(a).alias(names[0]), F.lit(b).alias(names[1])) for i, (a, b) in enumerate(pairs)]
    return table.select("found", F.inline(F.array(*listed))).select(*names, F.try_element_at("found", F.col("position")).alias("corr"))


def label_correlation(df: DataFrame, columns: Sequence[str] | None = None, n: int | None = 30, label: str = LABEL) -> DataFrame:
    """Signed correlation of each column with the label, strongest first; all numeric columns but ids by default."""
    columns = list(columns or numeric_columns(df.schema, exclude=(label, "cc_num", "unix_time")))
    out = _correlations(df, [(c, label) for c in columns], ("feature", "_label")).drop("_label")
    out = out.orderBy(F.abs("corr").desc_nulls_last(), F.asc("feature"))
    return out if n is None else out.limit(n)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower triangle in long form: (row, col, corr) with ``col`` listed before ``row``."""
    return _correlations(df, [(b, a) for a, b in combinations(columns, 2)], ("row", "col"))


def strongest_matrix(df: DataFrame, columns: Sequence[str] | None = None, n: int = 20, label: str = LABEL) -> DataFrame:
    """Matrix of the n columns most correlated with the label, and the label; n names pass through the driver."""
    top = [r["feature"] for r in label_correlation(df, columns, n, label).collect()]
    return correlation_matrix(df, [*top, label])
