"""Null-aware scalar building blocks, all native Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo, hi) -> Column:
    """Bound to [lo, hi]; null stays null (greatest/least alone would skip it)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b with a zero or null base giving 0."""
    return F.coalesce(F.try_divide(_col(a), _col(b)), F.lit(0.0))


def or_one(spread: Column | str) -> Column:
    """A standard deviation usable as divisor: null or zero becomes 1."""
    return F.coalesce(F.nullif(_col(spread), F.lit(0.0)), F.lit(1.0))


def flag(condition: Column) -> Column:
    """0/1 flag where an unknown condition counts as not met."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km; null when any coordinate is null."""
    phi1, phi2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    across = F.sin((phi2 - phi1) / 2)
    along = F.sin((F.radians(_col(lon2)) - F.radians(_col(lon1))) / 2)
    chord = across * across + F.cos(phi1) * F.cos(phi2) * along * along
    return F.asin(F.sqrt(clip(chord, 0.0, 1.0))) * (2 * EARTH_RADIUS_KM)


def cut_right_closed(c: Column | str, edges: Sequence, labels: Sequence) -> Column:
    """Label of the interval (edges[i], edges[i+1]] holding c; null outside all of them."""
    c = _col(c)
    out = F.when(c <= F.lit(edges[0]), F.lit(None))
    for upper, label in zip(edges[1:], labels, strict=True):
        out = out.when(c <= F.lit(upper), F.lit(label))
    return out


def equal_width_bin(c: Column | str, lo: Column, hi: Column, bins: Column | int) -> Column:
    """0-based histogram bin; the last bin is closed on the right, a zero-width range is bin 0."""
    bins = bins if isinstance(bins, Column) else F.lit(bins)
    position = F.coalesce(F.try_divide(_col(c) - lo, hi - lo), F.lit(0.0))
    return F.when(_col(c).isNotNull(), F.least(F.floor(position * bins), bins - 1).cast("int"))


# Decimal places of an amount that sums over time keep, in every plan shape and in streams.
MONEY_DIGITS = 4
MONEY_UNITS = 10**MONEY_DIGITS


def money_units(amount: Column | str, digits: int = 28) -> Column:
    """Amount as a whole number of 1/10,000 units, for sums that do not depend on their order; null beyond ``digits`` digits."""
    return F.round(_col(amount) * MONEY_UNITS).try_cast(f"decimal({digits},0)")


def money(units: Column | str) -> Column:
    """Units back as an amount, to four places."""
    return F.round(F.coalesce(_col(units).cast("double"), F.lit(0.0)) / MONEY_UNITS, MONEY_DIGITS)


def key_hash(key: Column | str, seed: int) -> Column:
    """Seeded uniform integer in [0, 2^32) of a row key, equal in every engine that has md5."""
    text = F.concat(_col(key).cast("string"), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
