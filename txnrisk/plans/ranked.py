"""Value-ordered running totals and exact quantiles without a global sort in one task.

Rows collapse to distinct values first (map-side combine), the value axis is cut at sketch quantiles, and the
carried running sum of ``plans.running`` does the rest. The cuts only balance the work; any cuts give the
same totals.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.plans.running import Running, carried_running
from txnrisk.plans.scalars import small_side, with_row

ROWS_PER_BUCKET = 200_000
MAX_BUCKETS = 32_768


def value_splits(df: DataFrame, value: str, rows_per_bucket: int | None = None) -> list[float]:
    """At most MAX_BUCKETS - 1 ascending cut points; empty when one bucket is enough.

    A narrow count decides; only larger tables are sketched.
    """
    n = df.agg(F.count(value)).first()[0]
    buckets = min(MAX_BUCKETS, math.ceil(n / (rows_per_bucket or ROWS_PER_BUCKET)))
    if buckets < 2:
        return []
    shares = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    cuts = df.agg(F.expr(f"percentile_approx(`{value}`, array({shares}), 20000)")).first()[0]
    return sorted({float(c) for c in cuts})


def bucket_of(value: str, splits: Sequence[float]) -> Column:
    """Number of cut points below the value, found in two short comparison rounds."""
    if not splits:
        return F.lit(0)
    x = F.col(value)
    block = max(1, math.isqrt(len(splits)))
    coarse = list(splits[block - 1 :: block])
    padded = list(splits) + [math.inf] * block
    fences = F.lit([float(s) for s in padded])
    passed = sum((F.when(x > F.lit(c), 1).otherwise(0) for c in coarse), F.lit(0))
    start = passed * block
    inner = sum((F.when(x > F.get(fences, start + i), 1).otherwise(0) for i in range(block)), F.lit(0))
    return start + inner


def ranked_totals(
    df: DataFrame,
    value: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Per distinct value (within ``by``): each sum, and ``cum_<name>`` over the values up to and including it."""
    if splits is None:
        splits = value_splits(df, value)
    levels = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    bucket = bucket_of(value, splits)
    order = F.col(value).desc() if descending else F.col(value).asc()
    specs = {f"cum_{n}": Running("sum", F.col(n)) for n in sums}
    return carried_running(levels, list(by), -bucket if descending else bucket, [order], specs)


def exact_quantiles(
    df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = (), splits: Sequence[float] | None = None
) -> DataFrame:
    """Linear-interpolated quantiles, one row per ``by`` group and one column per entry of ``shares``."""
    ranks = ranked_totals(df, value, {"n": F.lit(1)}, by, splits=splits)
    if by:
        total = df.groupBy(*by).agg(F.count(value).alias("_n"))
        total = small_side(total.select(*[F.col(k).alias(f"_g_{k}") for k in by], "_n"))
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
        ranks = ranks.join(total, same)
    else:
        ranks = with_row(ranks, df.agg(F.count(value).alias("_n")))
    picks, outputs = [], []
    for name, share in shares.items():
        position = (F.col("_n") - 1) * share
        low, high = F.floor(position), F.ceil(position)
        picks += [
            F.min(F.when(F.col("cum_n") > low, F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("cum_n") > high, F.col(value))).alias(f"_hi_{name}"),
            F.first(position - low).alias(f"_w_{name}"),
        ]
        low_value, high_value = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outputs.append((low_value + (high_value - low_value) * F.col(f"_w_{name}")).alias(name))
    return ranks.groupBy(*by).agg(*picks).select(*by, *outputs)
