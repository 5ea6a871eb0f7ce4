"""Timestamps that arrive as text, and differences in hours and days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")


def parse_time(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def time_text(ts: Column, day_only: Column | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, or the day alone where only that is known: sorts in time order as text."""
    full = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return full if day_only is None else F.when(day_only, F.date_format(ts, "yyyy-MM-dd")).otherwise(full)


def precise(text: Column) -> Column:
    return F.coalesce(F.length(text) > 10, F.lit(False))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def hours_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / F.lit(3.6e9)


def whole_days(a: Column, b: Column) -> Column:
    return F.floor((micros(b) - micros(a)) / F.lit(8.64e10))


def plus_hours(ts: Column, hours: float) -> Column:
    return F.timestamp_micros(micros(ts) + F.lit(int(hours * 3_600_000_000)))
