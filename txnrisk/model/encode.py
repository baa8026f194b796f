"""Feature selection, category codes and the null sentinel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.schema import CALENDAR_CATEGORIES, GEO_COLUMNS, KEY_COLUMNS, NULL_CATEGORY, SENTINEL, TEXT_CATEGORIES
from txnrisk.session import materialise

CATEGORIES = TEXT_CATEGORIES + CALENDAR_CATEGORIES
# The dictionary of a column is broadcast to the rows up to this many bytes; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32_000_000
# Categories of a column that are written into the plan as a map, which is searched one by one; a longer dictionary is joined.
MAPPED_ROWS = 100
# Categories of a column that one task numbers; more are cut into ranges.
NUMBERED_ROWS = 200_000


def feature_columns(
    schema: T.StructType, categories: Sequence[str] = CATEGORIES, exclude: Sequence[str] = (*KEY_COLUMNS, *GEO_COLUMNS)
) -> list[str]:
    """Model inputs in a stable order: numeric columns as the table lists them, then text categories."""
    numeric = [f.name for f in schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
    present = [c for c in categories if c in schema.names and c not in numeric]
    return numeric + present


def fill_sentinel(df: DataFrame, columns: Sequence[str], value: float = SENTINEL) -> DataFrame:
    return df.fillna(value, list(columns))


def _text(c: str, null_as: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(null_as))


def fit_encoders(df: DataFrame, columns: Sequence[str] = CATEGORIES, null_as: str = NULL_CATEGORY) -> DataFrame:
    """(column, category, code): codes 0.. in category order, numeric columns in numeric order with null last.

    All columns in one scan; rows collapse to categories before the shuffle. A column of many categories is cut into ranges that
    are numbered side by side.
    """
    columns = [c for c in columns if c in df.columns]
    numeric = [f.name for f in df.schema if f.name in columns and isinstance(f.dataType, T.NumericType)]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _text(c, null_as).alias("category")) for c in columns])
    # Collapsed to categories, and stored: counts, cuts and numbers read it.
    seen = materialise(df.select(F.inline(pairs)).distinct(), "categories")
    number = F.when(F.col("column").isin(numeric), F.col("category").try_cast("double"))
    order = [number.asc_nulls_last(), F.col("category").asc()]
    counts = seen.groupBy("column").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (counts[0] or 0) <= NUMBERED_ROWS:
        return seen.withColumn("code", (F.row_number().over(Window.partitionBy("column").orderBy(*order)) - 1).cast("int"))
    cuts = -(-counts[1] // NUMBERED_ROWS)
    placed = materialise(seen.repartitionByRange(cuts, "column", *order).withColumn("_part", F.spark_partition_id()), "category-ranges")
    earlier = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("column", "_part").orderBy(*order))
    numbered = placed.withColumn("_inside", inside).join(before.drop("_n"), ["column", "_part"])
    return numbered.select("column", "category", (F.col("_before") + F.col("_inside") - 1).cast("int").alias("code"))


def apply_encoders(
    df: DataFrame, encoders: DataFrame, columns: Sequence[str], unseen: int = -1, null_as: str = NULL_CATEGORY
) -> DataFrame:
    """Replace each column by its code; unseen categories and missing columns give ``unseen``.

    ``encoders`` is read once per longer column, so store it first (``session.materialise`` or a bundle). Dictionaries of up to MAPPED_ROWS
    categories are looked up in place, all columns in one pass over the rows; a join a column would copy the rows every time. The part of
    each other column is measured and broadcast only up to BROADCAST_BYTES.
    """
    width = F.sum(F.octet_length("category") + 24)
    count = F.count(F.lit(1)).alias("n")
    size = {r["column"]: r for r in encoders.groupBy("column").agg(width.alias("bytes"), count, F.count_distinct("category").alias("distinct")).collect()}
    mapped = [c for c, r in size.items() if c in columns and c in df.columns and r["n"] <= MAPPED_ROWS and r["n"] == r["distinct"]]
    maps: dict[str, dict[str, int]] = {c: {} for c in mapped}
    for r in encoders.where(F.col("column").isin(mapped)).select("column", "category", "code").collect() if mapped else []:
        maps[r["column"]][r["category"]] = r["code"]
    out = df
    for c in columns:
        if c not in df.columns:
            out = out.withColumn(c, F.lit(unseen))
            continue
        if c in maps:
            continue
        codes = encoders.where(F.col("column") == c).select(F.col("category").alias("_category"), F.col("code").alias("_code"))
        codes = F.broadcast(codes) if c not in size or size[c]["bytes"] <= BROADCAST_BYTES else codes
        out = out.join(codes, _text(c, null_as) == F.col("_category"), "left")
        out = out.withColumn(c, F.coalesce("_code", F.lit(unseen))).drop("_category", "_code")

    def code(c: str) -> Column:
        entries = [F.lit(x) for pair in sorted(maps[c].items()) for x in pair]
        return F.coalesce(F.try_element_at(F.create_map(*entries), _text(c, null_as)), F.lit(unseen))

    return out.withColumns({c: code(c) for c in maps})


def apply_encoders_first(df: DataFrame, encoders: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variant where unseen categories take the first class; fit with ``null_as='nan'``."""
    return apply_encoders(df, encoders, columns, unseen=0, null_as="nan")


def numeric_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features in model order as doubles: missing columns, nulls and unreadable values become the sentinel."""

    def value(c: str) -> Column:
        return F.coalesce(F.col(c).try_cast("double"), F.lit(SENTINEL)) if c in df.columns else F.lit(SENTINEL)

    rest = [F.col(c) for c in df.columns if c not in features]
    return df.select(*rest, *[value(c).alias(c) for c in features])
