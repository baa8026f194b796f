"""Sliding frames add amounts up in parts: the same totals, and no decimal is summed over a frame."""

from decimal import Decimal

from pyspark.sql import functions as F

from txnrisk.operators import velocity

SCHEMA = "trans_num long, cc_num long, unix_time long, amt double"


def test_parts_give_the_number_back(spark):
    numbers = [0, 1, -1, 10**10, -(10**20) - 7, 10**28 - 1, -(10**28) + 1, None]
    df = spark.createDataFrame([(None if n is None else Decimal(n),) for n in numbers], "x decimal(28,0)")
    cut = df.select("x", *[p.alias(f"p{i}") for i, p in enumerate(velocity.in_parts(F.col("x"), 10, 3))])
    assert [t for _, t in cut.dtypes[1:]] == ["bigint"] * 3
    back = cut.select("x", velocity.from_parts([F.col(f"p{i}") for i in range(3)], 10).alias("y")).collect()
    assert [r.x for r in back] == [r.y for r in back]


def test_frames_sum_longs_and_equal_the_heavy_plan(spark):
    amounts = [1.5, -2.25, None, 9e13, 1e22, -9e13, 0.0001, 1e25, float("nan"), 3.0, 7.5, 1e-9]
    rows = [(i, i % 2 if i % 5 else None, 1_000 * (i // 3), amounts[i % len(amounts)]) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    for add in (velocity.add_velocity, velocity.add_amount_deviation):
        plain, heavy = add(df, heavy_rows=10**9), add(df, heavy_rows=0)
        columns = plain.columns
        assert repr(plain.orderBy("trans_num").collect()) == repr(heavy.select(*columns).orderBy("trans_num").collect())
        text = plain._jdf.queryExecution().optimizedPlan().toString()
        frames = [part for part in text.split("windowspecdefinition") if "RangeFrame, -" in part]
        assert frames and "sum(_w" not in text and "decimal(38,0)) windowspec" not in text
