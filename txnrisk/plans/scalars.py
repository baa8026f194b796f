"""One-row statistics and small tables next to a large one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.session import materialise

# Bytes up to which a grouped statistic is broadcast.
SMALL_BYTES = 32_000_000


def table_bytes(df: DataFrame) -> int:
    """About the bytes that a table takes when it is broadcast."""
    width = F.lit(16 * len(df.columns))
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
    return df.agg(F.sum(width)).first()[0] or 0


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as a scalar subquery: evaluated once, no join."""
    value = row.select(F.struct(*row.columns).alias("_row")).scalar()
    return df.withColumn("_scalar", value).select(*df.columns, *[F.col(f"_scalar.{c}").alias(c) for c in row.columns])


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The table, written once; broadcast if it has at most ``limit`` bytes (measured), otherwise the planner shuffles."""
    stored = materialise(df, "small-side")
    return F.broadcast(stored) if table_bytes(stored) <= (SMALL_BYTES if limit is None else limit) else stored
