"""Column expressions for local time, durations and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_timestamp(text: Column) -> Column:
    """A timestamp, or null where the text isn't one."""
    return F.try_to_timestamp(text)


def utc_of(local: Column, zone: str) -> Column:
    return F.to_utc_timestamp(local, F.lit(zone))


def local_exists(local: Column, zone: str) -> Column:
    """Whether the wall clock shows this time at all: it isn't skipped by a change to summer time."""
    utc = utc_of(local, zone)
    return utc.isNotNull() & (F.from_utc_timestamp(utc, F.lit(zone)) == local)


def hour_bucket(at: Column) -> Column:
    return F.date_trunc("hour", at)


def calendar(at: Column, prefix: str) -> dict[str, Column]:
    parts = {"date": F.to_date(at), "year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at), "hour": F.hour(at)}
    return {f"{prefix}_{k}": v for k, v in parts.items()}


def minutes_between(start: Column, end: Column) -> Column:
    """By whole seconds, to two decimals."""
    return F.round((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60.0, 2)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def hash_key(parts: Sequence[Column]) -> Column:
    """SHA-256 of the parts as texts. A null part is an empty text, so no part takes another's place."""
    return F.sha2(F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def calendar_key(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """``YYYY_MM_DD_HH``; null if a part is."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(pad(year, 4), F.lit("_"), pad(month, 2), F.lit("_"), pad(day, 2), F.lit("_"), pad(hour, 2))


def mapped(value: Column, table: dict) -> Column:
    """By a small literal map; null where it has no entry."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)
