"""Trailing-window features per card: velocity, 30-day amount deviation, burst ratios.

Ordinary cards use sliding range frames: all of them, and every other per-card window, share one exchange and
one sort order. A sliding frame costs the number of rows inside it for every row, so heavy cards instead turn
each second's total into a gain when it enters a window and a loss when it leaves, and take a running sum.
Both shapes, and the streams, add up amounts as whole numbers of 1/10,000 units in decimals, so a card's values do not depend on
its number of rows, on the plan or on the order of addition. Sliding frames add every row up many times: there a number goes as a few
longs of equal numbers of digits, which are put together once a row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions import MONEY_UNITS, clip, money, money_units, or_one, safe_ratio
from txnrisk.plans.hotkeys import HEAVY_ROWS, Part, Step, rowwise, run_steps
from txnrisk.plans.running import Running, carried_running, time_segment
from txnrisk.schema import DEVIATION_SECONDS, HORIZONS

# Sums of units.
UNITS = "decimal(38,0)"
# Digits of each part of a number that sliding frames add up: sums of 900 million and of 9 million parts stay below 2^63.
AMOUNT_DIGITS, SQUARE_DIGITS = 10, 12


def in_parts(number: Column, digits: int, parts: int) -> list[Column]:
    """A whole decimal of at most ``digits`` times ``parts`` digits as longs, the highest first, all of its sign; nulls for null."""
    out, rest = [], number
    for i in range(parts - 1, 0, -1):
        unit = F.lit(Decimal(10 ** (digits * i)))
        out.append(F.call_function("div", rest, unit))
        rest = rest % unit
    return [*out, rest.cast("long")]


def from_parts(parts: Sequence[Column], digits: int) -> Column:
    """The whole number of the parts, or of the sums of parts."""
    total = parts[0].cast(UNITS)
    for part in parts[1:]:
        total = ((total * F.lit(Decimal(10**digits))).cast(UNITS) + part.cast(UNITS)).cast(UNITS)
    return total


def per_second(df: DataFrame) -> DataFrame:
    """(cc_num, unix_time, n, units): a card's rows and exact amount per second, all that trailing windows need."""
    return df.groupBy("cc_num", "unix_time").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(money_units("amt")), F.lit(0)).cast(UNITS).alias("units")
    )


def velocity(horizons: Mapping[str, int] = HORIZONS, feed: str | None = None) -> Step:
    """TxnCount_<h> and TxnAmount_<h> over the ``h`` seconds before the row's second, the row itself excluded.

    AvgTxnAmtLast24h (null amount base gives 0) is added when the 24h window is among them. With ``feed`` the
    windows look at that feed of ``per_second`` totals instead of the rows.
    """

    def with_average(df: DataFrame) -> DataFrame:
        if "24h" not in horizons:
            return df
        return df.withColumn("AvgTxnAmtLast24h", F.round(safe_ratio("TxnAmount_24h", "TxnCount_24h"), 4))

    def over_feed(df: DataFrame, part: Part) -> DataFrame:
        rest = [c for c in df.columns if c not in ("cc_num", "unix_time")]
        rows = df.select("cc_num", "unix_time", F.struct(*rest).alias("_row"))
        both = rows.unionByName(part.feeds[feed].select("cc_num", "unix_time", "n", "units"), allowMissingColumns=True)
        seq = Window.partitionBy("cc_num").orderBy("unix_time")
        cols = {}
        for name, seconds in horizons.items():
            frame = seq.rangeBetween(-seconds, -1)
            cols[f"TxnCount_{name}"] = F.coalesce(F.sum("n").over(frame), F.lit(0))
            cols[f"TxnAmount_{name}"] = money(F.sum("units").over(frame))
        out = both.withColumns(cols).where(F.col("_row").isNotNull())
        return with_average(out.select("cc_num", "unix_time", "_row.*", *cols))

    def plain(df: DataFrame, part: Part) -> DataFrame:
        if feed:
            return over_feed(df, part)
        seq = Window.partitionBy("cc_num").orderBy("unix_time")
        parts = {f"_units_{i}": c for i, c in enumerate(in_parts(money_units("amt"), AMOUNT_DIGITS, 3))}
        cols = {}
        for name, seconds in horizons.items():
            frame = seq.rangeBetween(-seconds, -1)
            cols[f"TxnCount_{name}"] = F.count(F.lit(1)).over(frame)
            cols[f"TxnAmount_{name}"] = money(from_parts([F.sum(c).over(frame) for c in parts], AMOUNT_DIGITS))
        return with_average(df.withColumns(parts).withColumns(cols).drop(*parts))

    def heavy(df: DataFrame, part: Part) -> DataFrame:
        if feed:
            totals = part.feeds[feed].groupBy("cc_num", "unix_time").agg(F.sum("n").alias("n"), F.sum("units").cast(UNITS).alias("units"))
        else:
            totals = per_second(part.base)
        # A second's total is visible from the next second on and leaves horizon h after h + 1 seconds.
        moves = [F.struct((F.col("unix_time") + 1).alias("at"), F.lit("").alias("h"), F.col("n"), F.col("units").alias("a"))]
        for name, seconds in horizons.items():
            gone = F.struct(
                (F.col("unix_time") + seconds + 1).alias("at"), F.lit(name).alias("h"), (-F.col("n")).alias("n"), (-F.col("units")).cast(UNITS).alias("a")
            )
            moves.append(gone)
        changes = totals.select("cc_num", F.explode(F.array(*moves)).alias("m")).select("cc_num", F.lit(0).alias("_kind"), "m.*")
        rows = df.select("cc_num", F.lit(1).alias("_kind"), F.col("unix_time").alias("at"), F.struct(*df.columns).alias("_row"))
        events = rows.unionByName(changes, allowMissingColumns=True)
        specs = {}
        for name in horizons:
            counted = F.col("h").isin("", name)
            specs[f"_n_{name}"] = Running("sum", F.when(counted, F.col("n")).otherwise(F.lit(0)))
            specs[f"_a_{name}"] = Running("sum", F.when(counted, F.col("a")).otherwise(F.lit(0).cast(UNITS)))
        order = [F.col("at"), F.col("_kind")]
        times = part.base.select("cc_num", F.lit(1).alias("_kind"), F.col("unix_time").alias("at"))
        history = times.unionByName(changes, allowMissingColumns=True)
        out = carried_running(events, ["cc_num"], time_segment("at", part.segment_seconds), order, specs, history=history).where(F.col("_kind") == 1)
        cols = []
        for name in horizons:
            cols.append(F.col(f"_n_{name}").alias(f"TxnCount_{name}"))
            cols.append(money(f"_a_{name}").alias(f"TxnAmount_{name}"))
        return with_average(out.select("_row.*", *cols))

    return Step(plain, heavy)


def _moves() -> dict[str, Column]:
    """What a row adds to count, sum and sum of squares of known amounts, exact for amounts below 10^14 (others are unknown)."""
    x = money_units("amt", 18)
    return {"n": x.isNotNull().cast("long"), "s": x.cast(UNITS), "q": (x * x).cast(UNITS)}


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _deviation(amount: str) -> Column:
    """z-score of an amount against count _n, sum _s and sum of squares _q of units; 0 with fewer than two."""
    n, total, squares = F.col("_n").cast("decimal(19,0)"), F.col("_s"), F.col("_q")
    # n²·variance, exact in whole numbers before the one square root; only sums of more than 38 digits go on in doubles.
    exact = F.try_subtract(F.try_multiply(n, squares), F.try_multiply(total, total)).cast("double")
    rough = F.col("_n") * squares.cast("double") - total.cast("double") * total.cast("double")
    spread = F.sqrt(F.greatest(F.coalesce(exact, rough), F.lit(0.0))) / F.col("_n") / MONEY_UNITS
    mean = total.cast("double") / F.col("_n") / MONEY_UNITS
    z = F.round((F.col(amount) - mean) / or_one(spread), 4)
    return F.when(F.col("_n") >= 2, z).otherwise(F.lit(0.0))


def amount_deviation(seconds: int = DEVIATION_SECONDS) -> Step:
    """AmountDeviation_30d: z-score against the card's earlier rows at most ``seconds`` old, 0 with fewer than two.

    Earlier rows of the same second count. The spread is the population one; zero spread divides by 1.
    """

    def plain(df: DataFrame, part: Part) -> DataFrame:
        # Earlier seconds of the window, and earlier rows of the same second: one exchange and sort serve both.
        window = Window.partitionBy("cc_num").orderBy("unix_time").rangeBetween(-seconds, -1)
        second = Window.partitionBy("cc_num", "unix_time").orderBy("trans_num").rowsBetween(Window.unboundedPreceding, -1)
        moves = _moves()
        digits = {"n": (1, 1), "s": (AMOUNT_DIGITS, 2), "q": (SQUARE_DIGITS, 3)}
        parts = {f"_{c}_{i}": p for c, m in moves.items() for i, p in enumerate(in_parts(m, *digits[c]))}
        added = df.withColumns(parts).withColumns({c: _added(F.sum(c).over(window), F.sum(c).over(second)) for c in parts})
        sums = {f"_{c}": from_parts([F.col(f"_{c}_{i}") for i in range(n)], d) for c, (d, n) in digits.items()}
        sums["_n"] = F.col("_n_0")
        return added.withColumns(sums).withColumn("AmountDeviation_30d", _deviation("amt")).drop(*parts, *sums)

    def heavy(df: DataFrame, part: Part) -> DataFrame:
        moves = [F.coalesce(m, F.lit(0)).cast(t).alias(c) for (c, m), t in zip(_moves().items(), ("long", UNITS, UNITS), strict=True)]
        key = ["cc_num", F.lit(1).alias("_kind"), F.col("unix_time").alias("at"), F.col("trans_num").alias("_id")]
        rows = df.select(*key, F.struct(*df.columns).alias("_row"), *moves)
        entering = part.base.select(*key, *moves)
        leaving = (
            entering.groupBy("cc_num", (F.col("at") + seconds + 1).alias("at"))
            .agg(*[(-F.sum(c)).cast(t).alias(c) for c, t in (("n", "long"), ("s", UNITS), ("q", UNITS))])
            .withColumn("_kind", F.lit(0))
        )
        events = rows.unionByName(leaving, allowMissingColumns=True)
        specs = {f"_{c}": Running("sum", F.col(c), inclusive=False) for c in ("n", "s", "q")}
        order = [F.col("at"), F.col("_kind"), F.col("_id")]
        history = entering.unionByName(leaving, allowMissingColumns=True)
        out = carried_running(events, ["cc_num"], time_segment("at", part.segment_seconds), order, specs, history=history).where(F.col("_kind") == 1)
        return out.select("_row.*", _deviation("_row.amt").alias("AmountDeviation_30d"))

    return Step(plain, heavy)


def burst_ratios() -> Step:
    """SpendBurstScore and VelocityAcceleration: last hour against the hourly base of the longer window."""

    def fn(df: DataFrame) -> DataFrame:
        spend = clip(safe_ratio("TxnAmount_1h", F.col("TxnAmount_7d") / 168), 0.0, 100.0)
        pace = clip(safe_ratio("TxnCount_1h", F.col("TxnCount_24h") / 24), 0.0, 100.0)
        return df.withColumns({"SpendBurstScore": F.round(spend, 4), "VelocityAcceleration": F.round(pace, 4)})

    return rowwise(fn)


def add_velocity(df: DataFrame, horizons: Mapping[str, int] = HORIZONS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    return run_steps(df, [velocity(horizons)], min_rows=heavy_rows)


def add_amount_deviation(df: DataFrame, seconds: int = DEVIATION_SECONDS, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    return run_steps(df, [amount_deviation(seconds)], min_rows=heavy_rows)


def add_burst_ratios(df: DataFrame) -> DataFrame:
    """From TxnAmount_1h/7d and TxnCount_1h/24h of the input."""
    return burst_ratios().plain(df, None)
