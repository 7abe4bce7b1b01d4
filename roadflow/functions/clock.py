"""Time bins and calendar features; all times are UTC seconds."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import TIME_INTERVAL_S


def date_str(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")


def tod_bin(ts: Column) -> Column:
    """Half-hour of the day, 0 to 47."""
    return F.floor(F.pmod(ts, F.lit(86400)) / TIME_INTERVAL_S).cast("int")


def hour(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(86400)) / 3600).cast("int")


def minute_of_day(ts: Column) -> Column:
    return F.floor(F.pmod(ts, F.lit(86400)) / 60).cast("int")


def day_of_week(ts: Column) -> Column:
    """0 for Monday."""
    return F.pmod(F.floor(ts / 86400) + 3, F.lit(7)).cast("int")


def floor_hour(ts: Column) -> Column:
    return ts - F.pmod(ts, F.lit(3600))


def hour_angle(ts: Column) -> Column:
    return 2 * math.pi * minute_of_day(ts) / 1440.0


def parse_query_time(text: Column) -> Column:
    """Seconds of a ``M/D/YY HH:MM`` text."""
    return F.unix_seconds(F.to_timestamp(text, "M/d/yy H:mm"))


def circular_hours(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 24 - d)
