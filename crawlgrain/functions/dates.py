"""Times: epoch seconds, ISO 8601, the next run of a schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def next_daily(after: Column, hour: int, minute: int) -> Column:
    """The first such time of day after a timestamp."""
    today = F.date_trunc("day", after) + F.make_interval(hours=F.lit(hour), mins=F.lit(minute))
    return F.when(today > after, today).otherwise(today + F.expr("interval 1 day"))


def next_weekly(after: Column, weekday: int, hour: int, minute: int) -> Column:
    """weekday: 1 is Sunday."""
    ahead = F.pmod(F.lit(weekday) - F.dayofweek(after), F.lit(7))
    at = F.date_trunc("day", after) + F.make_interval(days=ahead, hours=F.lit(hour), mins=F.lit(minute))
    return F.when(at > after, at).otherwise(at + F.expr("interval 7 days"))


def next_monthly(after: Column, day: int, hour: int, minute: int) -> Column:
    """In months that are too short, their last day."""

    def at(month: Column) -> Column:
        d = F.least(F.lit(day), F.dayofmonth(F.last_day(month)))
        return month + F.make_interval(days=d - 1, hours=F.lit(hour), mins=F.lit(minute))

    this = F.date_trunc("month", after)
    return F.when(at(this) > after, at(this)).otherwise(at(this + F.expr("interval 1 month")))
