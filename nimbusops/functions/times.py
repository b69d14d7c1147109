"""Column functions for zone-less local times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hhmm_minutes(hhmm: Column) -> Column:
    """Clock text such as '605', '0605' or '2400' as minutes after midnight; other text fails."""
    number = hhmm.cast("int")
    return number - 40 * F.floor(number / 100).cast("int")


def at_minute(day: Column, minutes: Column) -> Column:
    """Zone-less timestamp of a day plus minutes; 1440 is the next midnight."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(mins=minutes)


def plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(hours=hours.cast("int"))


def hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(n))


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def minutes(n: int) -> Column:
    return F.make_dt_interval(mins=F.lit(n))


def trunc(unit: str, ts: Column) -> Column:
    """date_trunc that stays zone-less."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end for hour-aligned values, negative when end is earlier."""
    return F.timestamp_diff("HOUR", start, end)


def utc_to_local(zone: Column | str, utc: Column) -> Column:
    """Zone-less UTC as zone-less local time. A fixed zone is resolved once, not per row; that form
    relies on the UTC session that `prepare` sets."""
    if isinstance(zone, str) and zone == "UTC":
        return utc
    if isinstance(zone, str):
        return F.from_utc_timestamp(utc.cast("timestamp"), zone).cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), zone, utc)
