"""Per-card distribution features and card profiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions import day_of_week, equal_width_bin, hour_of, is_night, is_weekend, or_one, safe_ratio
from txnrisk.operators.sequence import LINEAR_HEAVY_ROWS, ORDER, previous_values
from txnrisk.plans.hotkeys import Part, Step, rowwise, run_steps
from txnrisk.plans.joins import attach_stats

# Number of histogram bins is the number of gaps, at most this many.
MAX_GAP_BINS = 20


def card_aggregates(aggs: dict[str, Column], keys: tuple[str, ...] = ("cc_num",)) -> Step:
    """Group statistics on every row: a window for ordinary cards, a small broadcast for the bounded heavy list."""

    def plain(df: DataFrame, part: Part) -> DataFrame:
        group = Window.partitionBy(*keys)
        return df.withColumns({name: agg.over(group) for name, agg in aggs.items()})

    def heavy(df: DataFrame, part: Part) -> DataFrame:
        stats = part.base.groupBy(*keys).agg(*[agg.alias(name) for name, agg in aggs.items()])
        if keys != ("cc_num",):
            # Several rows per heavy card: their number is checked, and heavy pairs are split once more.
            return attach_stats(df, stats, keys)
        stats = part.per_key(stats.withColumnRenamed("cc_num", "_card"))
        return df.join(stats, F.col("cc_num").eqNullSafe(F.col("_card")), "left").drop("_card")

    return Step(plain, heavy)


def _finished(step: Step, finish: Callable[[DataFrame], DataFrame]) -> Step:
    return Step(lambda df, part: finish(step.plain(df, part)), lambda df, part: finish(step.heavy(df, part)))


def period_stats(cutoff: int) -> Step:
    """CardAvgAmt, CardStdAmt, CardMaxAmt from rows before ``cutoff``; all-time for cards without any."""
    before = F.when(F.col("unix_time") < cutoff, F.col("amt"))
    any_before = F.max(F.col("unix_time") < cutoff)
    raw = {
        "_any": any_before,
        "_avg_p": F.avg(before),
        "_std_p": F.stddev_samp(before),
        "_max_p": F.max(before),
        "_avg_a": F.avg("amt"),
        "_std_a": F.stddev_samp("amt"),
        "_max_a": F.max("amt"),
    }
    step = card_aggregates(raw)

    def finish(df: DataFrame) -> DataFrame:
        out = df.withColumns(
            {
                f"Card{name}Amt": F.when(F.col("_any"), F.col(f"_{short}_p")).otherwise(F.col(f"_{short}_a"))
                for name, short in (("Avg", "avg"), ("Std", "std"), ("Max", "max"))
            }
        )
        return out.drop(*raw)

    return _finished(step, finish)


def amount_zscore() -> Step:
    z = (F.col("amt") - F.col("CardAvgAmt")) / or_one("CardStdAmt")
    return rowwise(lambda df: df.withColumn("AmountZScore", F.round(z, 4)))


def time_of_day_deviation(cutoff: int | None = None) -> Step:
    """Hour against the card's mean hour, in sample standard deviations (plain, not circular, hours).

    ``cutoff`` takes mean and deviation from earlier rows only; null on cards without any.
    """
    hour = F.col("TransactionHour")
    hour = hour if cutoff is None else F.when(F.col("unix_time") < cutoff, hour)
    step = card_aggregates({"_h_avg": F.avg(hour), "_h_std": F.stddev_samp(hour)})

    def finish(df: DataFrame) -> DataFrame:
        z = (F.col("TransactionHour") - F.col("_h_avg")) / or_one("_h_std")
        return df.withColumn("TimeOfDayDeviation", F.round(z, 4)).drop("_h_avg", "_h_std")

    return _finished(step, finish)


def category_deviation(cutoff: int | None = None) -> Step:
    """1 - share of the card's rows in the row's category; 0 where the category is unknown.

    ``cutoff`` counts earlier rows only; a category new to the card is a full surprise.
    """
    one = F.count(F.lit(1)) if cutoff is None else F.count_if(F.col("unix_time") < cutoff)
    per_card, per_pair = card_aggregates({"_card_n": one}), card_aggregates({"_pair_n": one}, ("cc_num", "MerchantCategory"))

    def finish(df: DataFrame) -> DataFrame:
        surprise = F.round(1 - safe_ratio("_pair_n", "_card_n"), 4)
        known = F.col("MerchantCategory").isNotNull()
        out = df.withColumn("CategoryDeviationScore", F.when(known, surprise).otherwise(F.lit(0.0)))
        return out.drop("_card_n", "_pair_n")

    return Step(
        lambda df, part: finish(per_pair.plain(per_card.plain(df, part), part)),
        lambda df, part: finish(per_pair.heavy(per_card.heavy(df, part), part)),
    )


def inter_arrival_entropy() -> Step:
    """Shannon bits of the card's gap histogram (equal-width bins, as many as gaps, at most 20); 0 below two gaps.

    Expects ``prev_unix_time`` on the rows. Every gap in a bin adds the same information, so the entropy is the mean
    over gaps of -log2(share of the gap's bin).
    """
    gap = F.col("unix_time") - F.col("prev_unix_time")

    def plain(df: DataFrame, part: Part) -> DataFrame:
        card = Window.partitionBy("cc_num")
        out = df.withColumn("_gap", gap).withColumns(
            {"_n": F.count("_gap").over(card), "_lo": F.min("_gap").over(card), "_hi": F.max("_gap").over(card)}
        )
        out = out.withColumn("_bin", equal_width_bin("_gap", F.col("_lo"), F.col("_hi"), _bins()))
        out = out.withColumn("_c", F.count("_gap").over(Window.partitionBy("cc_num", "_bin")))
        bits = F.avg(F.when(F.col("_gap").isNotNull(), -F.log2(F.try_divide("_c", "_n")))).over(card)
        return _finish(out.withColumn("_bits", bits)).drop("_gap", "_lo", "_hi", "_bin", "_c")

    def heavy(df: DataFrame, part: Part) -> DataFrame:
        # Equal gaps collapse before anything else, then bins, then cards.
        ordered = previous_values({"prev_unix_time": "unix_time"}).heavy(part.base.select("cc_num", *ORDER), part)
        gaps = ordered.where(gap.isNotNull()).groupBy("cc_num", gap.alias("_gap")).agg(F.count(F.lit(1)).alias("_m"))
        ends = gaps.groupBy("cc_num").agg(F.sum("_m").alias("_n"), F.min("_gap").alias("_lo"), F.max("_gap").alias("_hi"))
        ends = part.per_key(ends.withColumnRenamed("cc_num", "_cc"))
        bins = gaps.join(ends, F.col("cc_num").eqNullSafe(F.col("_cc")))
        bins = bins.withColumn("_bin", equal_width_bin("_gap", F.col("_lo"), F.col("_hi"), _bins()))
        bins = bins.groupBy("_cc", "_n", "_bin").agg(F.sum("_m").alias("_c"))
        bits = bins.groupBy("_cc", "_n").agg(F.sum(-F.log2(F.col("_c") / F.col("_n")) * F.col("_c") / F.col("_n")).alias("_bits"))
        return _finish(df.join(part.per_key(bits), F.col("cc_num").eqNullSafe(F.col("_cc")), "left")).drop("_cc")

    return Step(plain, heavy)


def _bins() -> Column:
    return F.least(F.lit(MAX_GAP_BINS), F.col("_n"))


def _finish(df: DataFrame) -> DataFrame:
    value = F.when(F.col("_n") >= 2, F.round(F.col("_bits"), 4) + F.lit(0.0)).otherwise(F.lit(0.0))
    return df.withColumn("InterArrivalEntropy", value).drop("_n", "_bits")


def add_amount_zscore(df: DataFrame, cutoff: int, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    """AmountZScore from the period statistics, which are kept as CardAvgAmt, CardStdAmt, CardMaxAmt."""
    return run_steps(df, [period_stats(cutoff), amount_zscore()], min_rows=heavy_rows)


def add_time_of_day_deviation(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS, cutoff: int | None = None) -> DataFrame:
    return run_steps(df, [time_of_day_deviation(cutoff)], min_rows=heavy_rows)


def add_category_deviation(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS, cutoff: int | None = None) -> DataFrame:
    return run_steps(df, [category_deviation(cutoff)], min_rows=heavy_rows)


def add_inter_arrival_entropy(df: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    steps = [previous_values({"prev_unix_time": "unix_time"}), inter_arrival_entropy()]
    return run_steps(df, steps, min_rows=heavy_rows).drop("prev_unix_time")


def _diversity(seen: DataFrame, column: str, name: str) -> DataFrame:
    """Per card: distinct known values of a column before the cutoff (<name>_p) and ever (<name>_a)."""
    values = seen.where(F.col(column).isNotNull()).groupBy("cc_num", column).agg(F.max("_early").alias("_early"))
    return values.groupBy("cc_num").agg(F.count_if(F.col("_early")).alias(f"{name}_p"), F.count(F.lit(1)).alias(f"{name}_a"))


def card_period_stats(df: DataFrame, cutoff: int, approx: bool = False) -> DataFrame:
    """One row per card: amount statistics and merchant / category diversity of the train period, else all-time.

    ``approx`` counts distinct values with mergeable sketches instead of exactly. For exact counts rows collapse to distinct (card, merchant,
    category) first, which both counts share, instead of being expanded; they meet the statistics by card.
    """
    early = F.coalesce(F.col("unix_time") < cutoff, F.lit(False))
    before = F.when(early, F.col("amt"))
    counts = {"_mer": "merchant", "_cat": "MerchantCategory"}
    sketched = {f"{n}_{p}": F.approx_count_distinct(F.when(early, F.col(c)) if p == "p" else F.col(c)) for n, c in counts.items() for p in "pa"}
    numbers = df.groupBy("cc_num").agg(
        F.max(early).alias("in_train_period"),
        F.avg(before).alias("_avg_p"),
        F.stddev_samp(before).alias("_std_p"),
        F.max(before).alias("_max_p"),
        F.avg("amt").alias("_avg_a"),
        F.stddev_samp("amt").alias("_std_a"),
        F.max("amt").alias("_max_a"),
        *[c.alias(n) for n, c in sketched.items() if approx],
    )
    if not approx:
        seen = df.groupBy("cc_num", *counts.values()).agg(F.max(early).alias("_early"))
        parts = [_diversity(seen, c, n) for n, c in counts.items()]
        both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [numbers, *parts])
        # One row of each part per card, a null card included.
        numbers = both.groupBy("cc_num").agg(*[F.max(c).alias(c) for c in both.columns if c != "cc_num"]).fillna(0, list(sketched))
    pick = {
        "avg_amt": "avg",
        "std_amt": "std",
        "max_amt": "max",
        "merchant_diversity": "mer",
        "category_diversity": "cat",
    }
    return numbers.select(
        "cc_num",
        "in_train_period",
        *[F.when(F.col("in_train_period"), F.col(f"_{s}_p")).otherwise(F.col(f"_{s}_a")).alias(n) for n, s in pick.items()],
    )


def category_fractions(df: DataFrame) -> DataFrame:
    """(cc_num, MerchantCategory, frac); the base counts rows without a category too."""
    pairs = df.groupBy("cc_num", "MerchantCategory").agg(F.count(F.lit(1)).alias("_n"))
    # Pairs are already aggregated: a card has at most as many of them as there are categories.
    total = F.sum("_n").over(Window.partitionBy("cc_num"))
    return (
        pairs.withColumn("frac", F.col("_n") / total).where(F.col("MerchantCategory").isNotNull()).drop("_n")
    )


def customer_profile(df: DataFrame, attributes: dict[str, str]) -> DataFrame:
    """Per card: fraud rate, count, labelled rows, and the earliest non-null value of each attribute {new: source}."""
    order = F.struct(*ORDER)
    return df.groupBy("cc_num").agg(
        F.avg("is_fraud").alias("fraud_rate"),
        F.sum("is_fraud").alias("fraud_count"),
        F.count("is_fraud").alias("total_txns"),
        *[F.min_by(src, F.when(F.col(src).isNotNull(), order)).alias(new) for new, src in attributes.items()],
    )


def customer_summary(profile: DataFrame, rate: float = 0.05) -> DataFrame:
    """One row over a customer profile: customers, with any fraud, above the rate, mean account age by history."""
    age = F.col("acct_age")
    return profile.agg(
        F.count(F.lit(1)).alias("customers"),
        F.count_if(F.col("fraud_count") > 0).alias("with_any_fraud"),
        F.count_if(F.col("fraud_rate") > rate).alias("above_rate"),
        F.avg(F.when(F.col("prev_fraud_flag") == 1, age)).alias("age_prev_fraud"),
        F.avg(F.when(F.col("prev_fraud_flag") == 0, age)).alias("age_no_prev_fraud"),
    )


def add_calendar(df: DataFrame) -> DataFrame:
    """TransactionHour, DayOfWeek (1 = Sunday), IsWeekend, IsNightTxn from unix_time, in UTC."""
    return df.withColumns(
        {
            "TransactionHour": hour_of("unix_time"),
            "DayOfWeek": day_of_week("unix_time"),
            "IsWeekend": is_weekend("unix_time"),
            "IsNightTxn": is_night("unix_time"),
        }
    )
