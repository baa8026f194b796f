"""Running aggregates of a long sequence, cut into segments that carry their totals forward.

Segment totals are pre-aggregated (map-side combine), accumulated over the few segments of each key, and
joined back, so no task ever holds more than one segment of a key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Running(NamedTuple):
    """``sum`` or ``max`` of ``value`` over the rows before (``inclusive``: up to) the current one."""

    kind: str
    value: Column
    inclusive: bool = True


def time_segment(t: Column | str, seconds: int) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / seconds)


def plain_running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], specs: Mapping[str, Running]) -> DataFrame:
    """The same aggregates as one window per key; for keys whose rows fit one task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({name: _over(s, window) for name, s in specs.items()})


def carried_running(
    df: DataFrame,
    keys: Sequence[str],
    segment: Column,
    order: Sequence[Column],
    specs: Mapping[str, Running],
    history: DataFrame | None = None,
) -> DataFrame:
    """Add one column per spec, with segment totals carried over the segments of each key.

    ``segment`` must not decrease along ``order`` within a key. Sums need exact (integer or decimal) values
    to be equal to the uncut sum. ``history`` gives the same values for the totals from a cheaper plan; it
    needs the same keys and order columns, so that every segment of ``df`` has a total, but no others than those
    the specs read.
    """
    place = _place(df, keys)
    cut = df.withColumns(place).withColumn("_seg", segment)
    past = cut if history is None else history.withColumns(place).withColumn("_seg", segment)
    within = Window.partitionBy(*place, "_seg").orderBy(*order)
    earlier = Window.partitionBy(*place).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    totals = past.groupBy(*place, "_seg").agg(*[_agg(s.kind)(s.value).alias(f"_t_{n}") for n, s in specs.items()])
    carry = totals.select(*place, "_seg", *[_agg(s.kind)(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n, s in specs.items()])
    # Join and window use the same columns, so the rows are exchanged once for both.
    out = cut.join(carry, [*place, "_seg"], "left")
    out = out.withColumns({n: _combine(s.kind, F.col(f"_c_{n}"), _over(s, within)) for n, s in specs.items()})
    return out.select(*df.columns, *specs)


def _place(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Null-free stand-ins for the keys, on which plain equality treats null as a key of its own."""
    columns = {}
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        value = F.col(k) if isinstance(kind, (T.NumericType, T.StringType)) else F.col(k).cast("string")
        blank = F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else F.lit("")
        columns[f"_k{i}"], columns[f"_n{i}"] = F.coalesce(value, blank), F.col(k).isNull()
    return columns


def _agg(kind: str):
    return {"sum": F.sum, "max": F.max}[kind]


def _over(spec: Running, window) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
    return _agg(spec.kind)(spec.value).over(frame)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "max":
        return F.greatest(carried, local)
    return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
