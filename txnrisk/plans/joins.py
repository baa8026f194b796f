"""Joining group statistics back to rows.

Adaptive skew handling splits a join side that comes straight from a shuffle, but not one that was aggregated on
the join key, which group statistics are. So heavy keys are taken out here: their statistics are a bounded
broadcast and their rows are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.plans.hotkeys import Step, run_steps
from txnrisk.plans.scalars import SMALL_BYTES, table_bytes
from txnrisk.session import materialise

# Rows of one key that a shuffled join may put into one task.
JOIN_HEAVY_ROWS = 1_000_000


def attach_stats(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], small: int | None = None, heavy_rows: int = JOIN_HEAVY_ROWS
) -> DataFrame:
    """Left join of a table with one row per key; a null key is a key of its own.

    The statistics are written once. Up to ``small`` bytes (measured) they are broadcast whole. Beyond, rows of ordinary keys are joined by
    shuffle, rows of heavy keys by a broadcast of the heavy keys' statistics where their list is short.
    """
    small = SMALL_BYTES if small is None else small
    stored = materialise(stats, "statistics")
    if table_bytes(stored) <= small:
        return _join(df, F.broadcast(stored), keys)
    step = Step(
        lambda rows, part: _join(rows, part.feeds["stats"], keys),
        lambda rows, part: _join(rows, part.per_key(part.feeds["stats"]), keys),
    )
    return run_steps(df, [step], keys, heavy_rows, feeds={"stats": stored})


def _join(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = stats.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return df.join(side, same, "left").drop(*[f"_on_{k}" for k in keys])
