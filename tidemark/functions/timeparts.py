"""Dates, clocks, seasons and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import _c

# Fixed value: a season starts in July and carries the year it starts in.
SEASON_FIRST_MONTH = 7


def season_start(day: Column | str) -> Column:
    """Calendar year in which the season holding `day` started."""
    day = _c(day)
    return F.when(F.month(day) >= SEASON_FIRST_MONTH, F.year(day)).otherwise(F.year(day) - 1)


def season_label(start: Column | str) -> Column:
    """2023 -> '2023-24'."""
    start = _c(start)
    return F.concat(start.cast("string"), F.lit("-"), F.right((start + 1).cast("string"), F.lit(2)))


def partial_date(text: Column | str) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD to the first day it can mean."""
    text = _c(text)
    filled = (
        F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01")))
        .when(F.length(text) == 7, F.concat(text, F.lit("-01")))
        .otherwise(text)
    )
    return F.to_date(filled)


# Buckets of any width are counted from this Monday, as time_bucket() of other engines does.
_BUCKET_ORIGIN_MINUTES = 946_857_600 // 60


def bucket_start(ts: Column | str, minutes: int) -> Column:
    """Start of the fixed-width bucket of any number of minutes, counted from 2000-01-03."""
    offset = _BUCKET_ORIGIN_MINUTES % minutes
    width = f"{minutes} minutes"
    return F.window(_c(ts), width, width, f"{offset} minutes")["start"]


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole-second boundaries crossed between two instants."""
    a = F.date_trunc("second", _c(start)).cast("timestamp")
    b = F.date_trunc("second", _c(end)).cast("timestamp")
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def days_between(start: Column | str, end: Column | str) -> Column:
    """Midnights crossed between two instants."""
    return F.datediff(_c(end), _c(start)).cast("bigint")


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Completed 24-hour periods between two instants."""
    a, b = _c(start).cast("timestamp"), _c(end).cast("timestamp")
    return F.floor((F.unix_micros(b) - F.unix_micros(a)) / F.lit(86_400_000_000)).cast("bigint")


def clock_seconds(text: Column | str) -> Column:
    """'HH:MM[:SS[.fff]]' to seconds since midnight."""
    parts = F.split(_c(text), ":")
    return (
        parts[0].try_cast("double") * 3600
        + parts[1].try_cast("double") * 60
        + F.coalesce(F.try_element_at(parts, F.lit(3)).try_cast("double"), F.lit(0.0))
    )


def from_millis(ms: Column | str) -> Column:
    return F.timestamp_millis(_c(ms))
