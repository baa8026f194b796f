"""Equal-width histograms as grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import clip, equal_width_bin
from txnrisk.plans.scalars import small_side, with_row


def histogram(
    df: DataFrame,
    column: str,
    bins: int,
    by: str | None = None,
    lo: float | None = None,
    hi: float | None = None,
    own_range: bool = False,
) -> DataFrame:
    """(by, bin, bin_low, bin_high, n, density); values are clipped to [lo, hi] first where given.

    The range is the one of the whole (clipped) column, or with ``own_range`` of each group. Rows collapse to
    (group, bin) before any shuffle.
    """
    x = F.col(column)
    if lo is not None and hi is not None:
        x = clip(x, lo, hi)
    group = F.col(by) if by else F.lit(0)
    data = df.select(group.alias("_g"), x.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    ends = [F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    if own_range and by:
        ranges = small_side(data.groupBy("_g").agg(*ends).withColumnRenamed("_g", "_r"))
        placed = data.join(ranges, F.col("_g").eqNullSafe(F.col("_r"))).drop("_r")
    else:
        placed = with_row(data, data.agg(*ends))
    counted = (
        placed.withColumn("bin", equal_width_bin("_x", F.col("_lo"), F.col("_hi"), bins))
        .groupBy("_g", "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most ``bins`` rows per group from here on.
    totals = counted.groupBy("_g").agg(F.sum("n").alias("_total")).withColumnRenamed("_g", "_t")
    width = (F.col("_hi") - F.col("_lo")) / bins
    out = counted.join(totals, F.col("_g").eqNullSafe(F.col("_t"))).select(
        F.col("_g").alias(by or "_g"),
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_low"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_high"),
        "n",
        F.try_divide(F.col("n"), F.col("_total") * width).alias("density"),
    )
    return out if by else out.drop("_g")
