"""Column functions against Python and numpy."""


import hashlib
import random
from datetime import UTC, datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import sample
from txnrisk import functions as fn


def _column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_clip_and_ratio_and_spread(spark):
    assert _column(spark, [None, -5.0, 2.0, 9.0], "double", fn.clip("x", 0.0, 5.0)) == [None, 0.0, 2.0, 5.0]
    assert _column(spark, [None, 0.0, 4.0], "double", fn.safe_ratio(F.lit(8.0), "x")) == [0.0, 0.0, 2.0]
    assert _column(spark, [None, 0.0, 0.5], "double", fn.or_one("x")) == [1.0, 1.0, 0.5]
    assert _column(spark, [None, 1.0, 3.0], "double", fn.flag(F.col("x") > 2)) == [0, 0, 1]


def test_right_closed_edges(spark):
    got = _column(spark, [None, -1.0, -0.5, 1.0, 1.1, 7.0, 7.5], "double", fn.cut_right_closed("x", [-1, 1, 7], ["a", "b"]))
    assert got == [None, None, "a", "a", "b", "b", None]


@pytest.mark.parametrize("bins", [1, 3, 20])
def test_bins_match_numpy(spark, bins):
    values = [float(random.Random(bins).randint(0, 200)) for _ in range(3)] + [float(v) for v in random.Random(1).sample(range(500), 40)]
    lo, hi = min(values), max(values)
    got = _column(spark, values, "double", fn.equal_width_bin("x", F.lit(lo), F.lit(hi), bins))
    counts, _ = np.histogram(values, bins=bins)
    assert [got.count(b) for b in range(bins)] == counts.tolist()
    assert _column(spark, [3.0, None], "double", fn.equal_width_bin("x", F.lit(3.0), F.lit(3.0), bins)) == [0, None]


def test_distance(spark):
    rng = random.Random(5)
    points = [tuple(rng.uniform(-89, 89) if k % 2 == 0 else rng.uniform(-180, 180) for k in range(4)) for _ in range(200)]
    points += [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0), (None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, a double, b double, c double, d double")
    got = [r[0] for r in df.orderBy("i").select(fn.haversine_km("a", "b", "c", "d")).collect()]
    for value, point in zip(got, points, strict=True):
        want = sample.km(*point)
        assert value is None if want is None else value == pytest.approx(want, abs=1e-6)


def test_clock_is_utc(spark):
    seconds = [0, 1, 86_399, 86_400, 951_868_800, 1_577_836_799, 1_704_067_200, -1, -86_401]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        parts = F.struct(fn.hour_of("x"), fn.day_of_week("x"), fn.is_weekend("x"), fn.is_night("x"))
        got = [tuple(r) for r in _column(spark, seconds, "long", parts)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for s, part in zip(seconds, got, strict=True):
        t = datetime.fromtimestamp(s, UTC)
        day = t.isoweekday() % 7 + 1
        assert part == (t.hour, day, int(day in (1, 7)), int(t.hour <= 5))


def test_hash_is_md5(spark):
    keys = ["a", "tx-1", "7"]
    want = [int(hashlib.md5(f"{k}#9".encode()).hexdigest()[:8], 16) for k in keys]
    assert _column(spark, keys, "string", fn.key_hash("x", 9)) == want


def test_money_units(spark):
    assert _column(spark, [0.1, 19.99, -3.005, None], "double", fn.money_units("x")) == [Decimal(1000), Decimal(199900), Decimal(-30050), None]
