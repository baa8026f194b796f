"""Per-card sequence features: previous location, gaps, merchant visits, amount rank.

Order within a card is (unix_time, trans_num).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions import flag, haversine_km, safe_ratio
from txnrisk.plans.hotkeys import HEAVY_ROWS, Part, Step, rowwise, run_steps
from txnrisk.plans.ranked import bucket_of, value_splits
from txnrisk.plans.running import Running, carried_running, time_segment
from txnrisk.session import materialise

# Linear work per key: far larger keys than for sliding frames still fit one task.
LINEAR_HEAVY_ROWS = 1_000_000

ORDER = ["unix_time", "trans_num"]
IMPOSSIBLE_KMH = 500.0


def previous_values(columns: dict[str, str], key: str = "cc_num", order: list[str] | None = None) -> Step:
    """Value of each source column on the card's previous row: {new name: source}."""
    order = order or ORDER

    def plain(df: DataFrame, part: Part) -> DataFrame:
        seq = Window.partitionBy(key).orderBy(*order)
        return df.withColumns({new: F.lag(src, 1).over(seq) for new, src in columns.items()})

    def heavy(df: DataFrame, part: Part) -> DataFrame:
        row = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *[F.col(s).alias(n) for n, s in columns.items()])
        # The last row before this one is the largest (time, id) struct before it.
        specs = {"_prev": Running("max", row, inclusive=False)}
        out = carried_running(df, [key], time_segment(order[0], part.segment_seconds), [F.col(o) for o in order], specs, history=part.base)
        return out.withColumns({new: F.col(f"_prev.{new}") for new in columns}).drop("_prev")

    return Step(plain, heavy)


def previous_location() -> Step:
    return previous_values({"prev_merch_lat": "merch_lat", "prev_merch_long": "merch_long", "prev_unix_time": "unix_time"})


def time_since_last() -> Step:
    return rowwise(
        lambda df: df.withColumn(
            "TimeSinceLastTxnSec", F.coalesce(F.col("unix_time") - F.col("prev_unix_time"), F.lit(0)).cast("double")
        )
    )


def travel_features() -> Step:
    """Distances, and the impossible-travel flag (faster than 500 km/h since the last transaction)."""

    def fn(df: DataFrame) -> DataFrame:
        home = haversine_km("cust_lat", "cust_long", "merch_lat", "merch_long")
        hop = haversine_km("prev_merch_lat", "prev_merch_long", "merch_lat", "merch_long")
        hours = F.col("TimeSinceLastTxnSec") / 3600
        return df.withColumns(
            {"DistanceFromHome": F.round(home, 2), "DistanceFromLastTxn": F.coalesce(F.round(hop, 2), F.lit(0.0))}
        ).withColumn("ImpossibleTravelFlag", flag(F.try_divide("DistanceFromLastTxn", hours) > IMPOSSIBLE_KMH))

    return rowwise(fn)


def geo_speed_flag(min_km: float, max_gap_sec: float) -> Step:
    return rowwise(
        lambda df: df.withColumn(
            "SuspiciousGeoSpeedFlag",
            flag(
                (F.col("DistanceFromLastTxn") >= min_km)
                & F.col("prev_unix_time").isNotNull()
                & (F.col("TimeSinceLastTxnSec") <= max_gap_sec)
            ),
        )
    )


def add_previous_location(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    """Merchant coordinates and time of the card's previous transaction."""
    return run_steps(df, [previous_location()], min_rows=heavy_rows)


def add_time_since_last(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    """Seconds since the card's previous transaction, 0 on its first."""
    steps = [previous_values({"prev_unix_time": "unix_time"}), time_since_last()]
    return run_steps(df, steps, min_rows=heavy_rows).drop("prev_unix_time")


def add_travel(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    """DistanceFromHome, DistanceFromLastTxn and ImpossibleTravelFlag."""
    return run_steps(df, [previous_location(), time_since_last(), travel_features()], min_rows=heavy_rows)


def add_geo_speed_flag(
    df: DataFrame, min_km: float = 100.0, max_gap_sec: float = 3_600.0, heavy_rows: int = LINEAR_HEAVY_ROWS
) -> DataFrame:
    """Large merchant jump within a short gap."""
    steps = [previous_location(), time_since_last(), travel_features(), geo_speed_flag(min_km, max_gap_sec)]
    return run_steps(df, steps, min_rows=heavy_rows)


def inter_arrival_gaps(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    """One row per transaction after a card's first: (cc_num, trans_num, gap_sec)."""
    out = run_steps(df.select("cc_num", *ORDER), [previous_values({"prev_unix_time": "unix_time"})], min_rows=heavy_rows)
    return out.where(F.col("prev_unix_time").isNotNull()).select(
        "cc_num", "trans_num", (F.col("unix_time") - F.col("prev_unix_time")).alias("gap_sec")
    )


def merchant_visits() -> Step:
    """MerchantVisitRank and IsFirstAtMerchant; both null where the merchant is unknown."""
    keys = ["cc_num", "merchant"]

    def finish(df: DataFrame) -> DataFrame:
        known = F.col("merchant").isNotNull()
        return df.withColumn("MerchantVisitRank", F.when(known, F.col("_visit")).cast("long")).withColumn(
            "IsFirstAtMerchant", F.when(known, (F.col("_visit") == 1).cast("int"))
        ).drop("_visit")

    def plain(df: DataFrame, part: Part) -> DataFrame:
        return finish(df.withColumn("_visit", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER))))

    def heavy(df: DataFrame, part: Part) -> DataFrame:
        order = [F.col(o) for o in ORDER]
        specs = {"_visit": Running("sum", F.lit(1))}
        return finish(carried_running(df, keys, time_segment("unix_time", part.segment_seconds), order, specs, history=part.base))

    return Step(plain, heavy)


def add_merchant_visits(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    return run_steps(df, [merchant_visits()], keys=["cc_num", "merchant"], min_rows=heavy_rows)


def amount_rank() -> Step:
    """AmountPercentileRank: (rank - 1) / (n - 1) of the amount on its card, 0 for a single row."""

    def plain(df: DataFrame, part: Part) -> DataFrame:
        card = Window.partitionBy("cc_num").orderBy("amt")
        return df.withColumn("AmountPercentileRank", F.percent_rank().over(card))

    def heavy(df: DataFrame, part: Part) -> DataFrame:
        levels = part.base.groupBy("cc_num", "amt").agg(F.count(F.lit(1)).alias("_n"))
        order = [F.col("amt")]
        # Cut at quantiles of the amounts that are there; null amounts come first, in the first bucket.
        bucket = bucket_of("amt", value_splits(levels, "amt"))
        below = carried_running(levels, ["cc_num"], bucket, order, {"_below": Running("sum", F.col("_n"), inclusive=False)})
        total = levels.groupBy("cc_num").agg(F.sum("_n").alias("_total"))
        total = part.per_key(total.withColumnRenamed("cc_num", "_card"))
        rank = below.join(total, F.col("cc_num").eqNullSafe(F.col("_card"))).select(
            F.col("cc_num").alias("_cc"),
            F.col("amt").alias("_amt"),
            safe_ratio(F.coalesce("_below", F.lit(0)), F.col("_total") - 1).alias("AmountPercentileRank"),
        )
        same = F.col("cc_num").eqNullSafe(F.col("_cc")) & F.col("amt").eqNullSafe(F.col("_amt"))
        return df.join(rank, same, "left").drop("_cc", "_amt")

    return Step(plain, heavy)


def add_amount_rank(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    return run_steps(df, [amount_rank()], min_rows=heavy_rows)


# A card's rows are numbered in time order; the digits of the number in these bases name nested blocks of time.
PRIOR_BASE, PRIOR_HEAVY_BASE = 8, 32


def _digit(base: int, level: int) -> Column:
    return F.floor(F.col("_r") / base**level) % base


def prior_amount_rank(max_rows: int) -> Step:
    """PriorAmountPercentileRank: share of the card's earlier known amounts that are smaller; 0 without any, null for an unknown amount.

    Earlier *and* smaller is counted by blocks of time: of two rows, at one level the earlier one lies in an earlier block of the
    same enclosing block. There, with rows in order of amount, it is a running count per block. An ordinary card (at most
    ``max_rows`` rows) is sorted once a level inside its task. A heavy one collapses to counts per (enclosing block, amount) and carries
    them over ranges of amounts, so no task holds more than one block of time and amounts.
    """
    known = F.col("amt").isNotNull()

    def share(below: Column, earlier: Column) -> Column:
        return F.when(known, safe_ratio(below, earlier))

    def plain(df: DataFrame, part: Part) -> DataFrame:
        card = Window.partitionBy("cc_num").orderBy(*ORDER)
        out = df.withColumn("_r", F.row_number().over(card) - 1)
        out = out.withColumn("_earlier", F.count("amt").over(card.rowsBetween(Window.unboundedPreceding, -1)))
        below, level = F.lit(0), 0
        while PRIOR_BASE**level < max_rows:
            # Of equal amounts the later row comes first, so an earlier one never counts.
            block = Window.partitionBy("cc_num", F.floor(F.col("_r") / PRIOR_BASE ** (level + 1))).orderBy("amt", F.desc("_r"))
            before = block.rowsBetween(Window.unboundedPreceding, -1)
            digit = _digit(PRIOR_BASE, level)
            out = out.withColumns({f"_d{level}_{i}": F.count(F.when(known & (digit == i), 1)).over(before) for i in range(PRIOR_BASE - 1)})
            below = below + sum((F.when(digit > i, F.col(f"_d{level}_{i}")).otherwise(0) for i in range(PRIOR_BASE - 1)), F.lit(0))
            level += 1
        return out.withColumn("PriorAmountPercentileRank", share(below, F.col("_earlier"))).select(*df.columns, "PriorAmountPercentileRank")

    def heavy(df: DataFrame, part: Part) -> DataFrame:
        order = [F.col(o) for o in ORDER]
        specs = {"_r": Running("sum", F.lit(1), inclusive=False), "_earlier": Running("sum", known.cast("int"), inclusive=False)}
        narrow = part.base.select("cc_num", *ORDER, "amt")
        narrow = carried_running(narrow, ["cc_num"], time_segment("unix_time", part.segment_seconds), order, specs)
        # Written once: every level reads it.
        rows = materialise(narrow.withColumns({c: F.coalesce(c, F.lit(0)) for c in specs}), "prior-rank")
        bucket = bucket_of("amt", value_splits(rows, "amt"))
        most = rows.agg(F.max("_r")).first()[0] or 0
        below, level = [], 0
        while PRIOR_HEAVY_BASE**level <= most:
            block = F.floor(F.col("_r") / PRIOR_HEAVY_BASE ** (level + 1))
            placed = rows.where(known).select("cc_num", block.alias("_block"), "amt", "_r", _digit(PRIOR_HEAVY_BASE, level).alias("_digit"))
            counts = {f"_d{i}": F.count_if(F.col("_digit") == i) for i in range(PRIOR_HEAVY_BASE - 1)}
            amounts = placed.groupBy("cc_num", "_block", "amt").agg(*[c.alias(n) for n, c in counts.items()])
            smaller = {f"_s{i}": Running("sum", F.col(n), inclusive=False) for i, n in enumerate(counts)}
            amounts = carried_running(amounts, ["cc_num", "_block"], bucket, [F.col("amt")], smaller)
            side = amounts.select(F.col("cc_num").alias("_cc"), F.col("_block").alias("_b"), F.col("amt").alias("_amt"), *smaller)
            same = F.col("cc_num").eqNullSafe(F.col("_cc")) & (F.col("_block") == F.col("_b")) & (F.col("amt") == F.col("_amt"))
            own = sum((F.when(F.col("_digit") > i, F.coalesce(s, F.lit(0))).otherwise(0) for i, s in enumerate(smaller)), F.lit(0))
            below.append(placed.join(side, same).select("cc_num", "_r", own.alias("_below")))
            level += 1
        if not below:
            below = [rows.where("false").select("cc_num", "_r", F.lit(0).cast("long").alias("_below"))]
        total = reduce(DataFrame.unionAll, below).groupBy("cc_num", "_r").agg(F.sum("_below").alias("_below"))
        ranked = rows.join(total.withColumnsRenamed({"cc_num": "_cc", "_r": "_rr"}), F.col("cc_num").eqNullSafe(F.col("_cc")) & (F.col("_r") == F.col("_rr")), "left")
        value = share(F.coalesce("_below", F.lit(0)), F.col("_earlier"))
        ranked = ranked.select(*[F.col(c).alias(f"_on_{c}") for c in ("cc_num", *ORDER)], value.alias("PriorAmountPercentileRank"))
        same = F.col("cc_num").eqNullSafe(F.col("_on_cc_num")) & F.col("unix_time").eqNullSafe(F.col("_on_unix_time")) & F.col("trans_num").eqNullSafe(F.col("_on_trans_num"))
        return df.join(ranked, same, "left").drop("_on_cc_num", "_on_unix_time", "_on_trans_num")

    return Step(plain, heavy)


def add_prior_amount_rank(df: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Rank of each amount in the card's history so far; ``trans_num`` is unique within a card."""
    return run_steps(df, [prior_amount_rank(heavy_rows)], min_rows=heavy_rows)

