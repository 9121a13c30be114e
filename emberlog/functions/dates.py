"""Times carried as ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from one timestamp to another, to one place; null where either is."""
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 6e7, 1)


def compact_day(ts: Column) -> Column:
    """A day as yyyyMMdd, the way that partitions are named."""
    return F.date_format(ts, "yyyyMMdd")
