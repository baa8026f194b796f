"""Calendar parts of epoch seconds, in UTC and independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def _seconds(t: Column | str) -> Column:
    return F.col(t) if isinstance(t, str) else t


def hour_of(t: Column | str) -> Column:
    return F.floor(F.pmod(_seconds(t), F.lit(DAY)) / 3600).cast("int")


def day_of_week(t: Column | str) -> Column:
    """1 = Sunday … 7 = Saturday; 1970-01-01 was a Thursday."""
    return (F.pmod(F.floor(_seconds(t) / DAY) + 4, F.lit(7)) + 1).cast("int")


def is_weekend(t: Column | str) -> Column:
    return day_of_week(t).isin(1, 7).cast("int")


def is_night(t: Column | str) -> Column:
    """Midnight to 5 am inclusive."""
    return (hour_of(t) <= 5).cast("int")
