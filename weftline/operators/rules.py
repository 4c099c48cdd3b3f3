"""Rules by column for the named conditions of a specification. Each builder gives ``{"<column>:<what>": SQL}``."""

from __future__ import annotations

from collections.abc import Mapping

#: A repeated wall clock counts as its first instant; a skipped one names none.
NAMES_INSTANT = ("ok", "repeated")


def present(*columns: str) -> dict[str, str]:
    return {f"{c}:present": f"`{c}` IS NOT NULL" for c in columns}


def not_blank(*columns: str) -> dict[str, str]:
    return {f"{c}:present": f"trim(`{c}`) <> ''" for c in columns}


def within(column: str, low: float, high: float | None = None, optional: bool = False) -> dict[str, str]:
    """A number from low to high, or without an upper end any finite one; NaN is none. optional: null passes too."""
    top = f"`{column}` <= {high!r}" if high is not None else f"`{column}` < double('infinity')"
    # NaN is larger than any number, infinity included, so the upper bound rejects it.
    good = f"`{column}` >= {low!r} AND {top}"
    return {f"{column}:range": f"`{column}` IS NULL OR ({good})" if optional else good}


def instant(*names: str) -> dict[str, str]:
    """Of the specification's instants: the text names a moment."""
    known = ", ".join(f"'{s}'" for s in NAMES_INSTANT)
    return {f"{n}:instant": f"_{n}_status IN ({known})" for n in names}


def hash_of(*columns: str) -> str:
    """SQL of a key: SHA-256 of the columns' texts, an empty text standing for null, so that no part takes another's place."""
    return "sha2(concat_ws('||', " + ", ".join(f"coalesce(string(`{c}`), '')" for c in columns) + "), 256)"


def local_calendar(prefix: str, at: str, zone: str) -> dict[str, str]:
    """Derived columns of an instant's wall clock in a zone: the clock itself, date, year, month, day and hour."""
    local = f"{prefix}_local_datetime"
    parts = {"date": "to_date", "year": "year", "month": "month", "day": "dayofmonth", "hour": "hour"}
    return {local: f"from_utc_timestamp({at}, {zone})"} | {f"{prefix}_{n}": f"{f}({local})" for n, f in parts.items()}


def minutes(start: str, end: str) -> str:
    """SQL of whole seconds between two instants in minutes, to two decimals."""
    return f"round((unix_timestamp({end}) - unix_timestamp({start})) / 60.0D, 2)"


def mapped(table: Mapping[int, str], column: str) -> str:
    """SQL of a lookup in a small literal map; null where it has no entry."""
    return "try_element_at(map(" + ", ".join(f"{k}, '{v}'" for k, v in table.items()) + f"), {column})"
