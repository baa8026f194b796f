"""Heavy-key split.

A per-key window puts all rows of a key into one task. That is the cheapest plan for ordinary keys and
the wrong one for a key that holds a large share of the table. ``run_steps`` separates the two: rows of
ordinary keys keep the single-exchange window, rows of heavy keys take a plan that cuts the key into
segments. One narrow count (map-side combined) decides; without heavy keys only the first plan is built.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.session import materialise, size_shuffles

# A key is heavy above this many rows, whatever the size of the table.
HEAVY_ROWS = 20_000
# The list of heavy keys is broadcast up to this many bytes and joined by a shuffle beyond.
BROADCAST_BYTES = 32_000_000


# Widths a heavy key's timeline is cut to: the first one whose fullest segment has at most SEGMENT_ROWS rows, else the last.
SEGMENT_WIDTHS = (3_600, 60, 1)
SEGMENT_ROWS = 2_000_000


class Part(NamedTuple):
    """What a step may read besides the rows it extends: the untouched input rows and feeds of the same keys.

    Steps take their statistics from here, not from the rows built so far, so a chain of steps reads its
    input once per statistic instead of doubling the plan at every step. Rows of heavy keys are stored for that.
    """

    base: DataFrame
    feeds: Mapping[str, DataFrame]
    segment_seconds: int = SEGMENT_WIDTHS[0]
    few_keys: bool = True

    def per_key(self, stats: DataFrame) -> DataFrame:
        """A table of a few numbers per heavy key: broadcast like the list of those keys, or left to the planner like it."""
        return F.broadcast(stats) if self.few_keys else stats


Shape = Callable[[DataFrame, Part], DataFrame]


class Step(NamedTuple):
    """One operator in two shapes that give the same rows: (rows so far, part) -> rows with more columns."""

    plain: Shape
    heavy: Shape


def rowwise(fn: Callable[[DataFrame], DataFrame]) -> Step:
    """A step without a window: both shapes are the same."""
    return Step(lambda df, part: fn(df), lambda df, part: fn(df))


def heavy_keys(tables: Sequence[DataFrame], keys: Sequence[str], min_rows: int = HEAVY_ROWS) -> DataFrame:
    """Keys with more than ``min_rows`` rows in all tables together."""
    narrow = reduce(DataFrame.unionByName, [t.select(*keys) for t in tables])
    counts = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > min_rows).select(*[F.col(k).alias(f"_heavy_{k}") for k in keys])


def _sizes(tables: Sequence[DataFrame], keys: Sequence[str], min_rows: int) -> tuple[int, int]:
    """About the bytes that the list of heavy keys takes when it is broadcast, 0 for an empty one; and the rows of all tables."""
    narrow = reduce(DataFrame.unionByName, [t.select(*keys) for t in tables])
    counts = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    width = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) + 16 for k in keys])
    size, rows = counts.agg(F.sum(F.when(F.col("_n") > min_rows, width)), F.sum("_n")).first()
    return size or 0, rows or 0


def segment_width(tables: Sequence[DataFrame], keys: Sequence[str], t: str) -> int:
    """Segment width for rows of heavy keys, from counts per (key, segment)."""
    if any(t not in table.columns for table in tables):
        return SEGMENT_WIDTHS[0]
    narrow = reduce(DataFrame.unionByName, [table.select(*keys, t) for table in tables])
    for width in SEGMENT_WIDTHS[:-1]:
        counts = narrow.groupBy(*keys, F.floor(F.col(t) / width).alias("_seg")).agg(F.count(F.lit(1)).alias("_n"))
        if counts.where(F.col("_n") > SEGMENT_ROWS).isEmpty():
            return width
    return SEGMENT_WIDTHS[-1]


def run_steps(
    df: DataFrame,
    steps: Sequence[Step],
    keys: Sequence[str] = ("cc_num",),
    min_rows: int = HEAVY_ROWS,
    feeds: Mapping[str, DataFrame] | None = None,
    t: str = "unix_time",
) -> DataFrame:
    """Run the steps over ordinary and heavy keys, with one split for all of them.

    Keys count as heavy by their rows in ``df`` and in the ``feeds`` together; ``t`` is the time column the
    timelines of heavy keys are cut by.
    """
    feeds = dict(feeds or {})
    size, rows = _sizes([df, *feeds.values()], keys, min_rows)
    # All columns of the rows and of every window over them lie in one task's memory.
    size_shuffles(df.sparkSession, rows)
    if not size:
        part = Part(df, feeds)
        return reduce(lambda rows, step: step.plain(rows, part), steps, df)
    # Stored: the split reads the list on both sides of every table.
    heavy, few = materialise(heavy_keys([df, *feeds.values()], keys, min_rows), "heavy-keys"), size <= BROADCAST_BYTES
    if few:
        heavy = F.broadcast(heavy)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_heavy_{k}")) for k in keys])

    def take(how: str) -> Part:
        return Part(df.join(heavy, same, how), {n: f.join(heavy, same, how) for n, f in feeds.items()})

    ordinary, large = take("left_anti"), take("left_semi")
    # Every statistic of the heavy plan reads its rows: they are taken out of the input once.
    large = Part(materialise(large.base, "heavy-rows"), {n: materialise(f, "heavy-feed") for n, f in large.feeds.items()})
    large = large._replace(segment_seconds=segment_width([large.base, *large.feeds.values()], keys, t), few_keys=few)
    small_rows = reduce(lambda rows, step: step.plain(rows, ordinary), steps, ordinary.base)
    large_rows = reduce(lambda rows, step: step.heavy(rows, large), steps, large.base)
    return small_rows.unionByName(large_rows)
