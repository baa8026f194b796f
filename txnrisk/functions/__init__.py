"""Column functions: arithmetic, geometry, binning, formatting, calendar."""

from txnrisk.functions.clock import day_of_week, hour_of, is_night, is_weekend
from txnrisk.functions.scalar import (
    MONEY_UNITS,
    clip,
    cut_right_closed,
    equal_width_bin,
    flag,
    haversine_km,
    key_hash,
    money,
    money_units,
    or_one,
    safe_ratio,
)

__all__ = [
    "MONEY_UNITS",
    "clip",
    "cut_right_closed",
    "day_of_week",
    "equal_width_bin",
    "flag",
    "haversine_km",
    "hour_of",
    "is_night",
    "is_weekend",
    "key_hash",
    "money",
    "money_units",
    "or_one",
    "safe_ratio",
]
