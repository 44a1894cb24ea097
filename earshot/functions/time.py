"""Time expressions over epoch milliseconds, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def event_day(ms: Column) -> Column:
    """The UTC calendar date of an epoch-millisecond value."""
    return F.date_from_unix_date(F.floor(ms / F.lit(DAY_MS)).cast("int"))


def event_date(ms: Column) -> Column:
    """The UTC date as ``yyyy-MM-dd`` text, the lake's partition value."""
    return event_day(ms).cast("string")


def event_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def iso_to_ms(text: Column) -> Column:
    """ISO-8601 text to epoch milliseconds; unreadable text becomes null."""
    return F.unix_millis(F.try_to_timestamp(text))


def duration_to_ms(text: Column) -> Column:
    """``MM:SS`` or ``H:MM:SS`` to milliseconds; anything else is 0."""
    parts = F.split(text, ":")

    def part(i: int) -> Column:
        return F.trim(F.get(parts, F.lit(i))).try_cast("bigint")

    two = part(0) * 60 + part(1)
    three = part(0) * 3600 + part(1) * 60 + part(2)
    seconds = F.when(F.size(parts) == 2, two).when(F.size(parts) == 3, three)
    return F.coalesce(seconds * 1000, F.lit(0).cast("bigint"))


def bucket_of(ms: Column, width_ms: int) -> Column:
    """Index of the fixed-width time slice an instant falls into."""
    return F.floor(ms / F.lit(width_ms))
