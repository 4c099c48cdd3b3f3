"""Timestamps in mixed notations, as column expressions that stay in the JVM.

All notations are one regular expression with named groups. A value is matched once: ``regexp_replace`` rewrites it to
its components, joined by bars, which ``split`` takes apart. Ranges are checked on the integers, and the instant is
assembled by day arithmetic, so no format is tried after another and no parser is called row by row.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Offsets of zone abbreviations in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420,
}

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"

_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?"
    "|nov(?:ember)?|dec(?:ember)?"
)
_DATE = "|".join(
    [
        r"(?<yA>\d{4})-(?<mA>\d{1,2})-(?<dA>\d{1,2})",
        r"(?<yB>\d{4})-(?<nB>\d{3})",
        r"(?<yC>\d{4})/(?<mC>\d{1,2})/(?<dC>\d{1,2})",
        r"(?<mD>\d{1,2})/(?<dD>\d{1,2})/(?<yD>\d{4})",
        r"(?<dE>\d{1,2})\.(?<mE>\d{1,2})\.(?<yE>\d{4})",
        rf"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]{{0,6}},?\s+)?(?<dF>\d{{1,2}})[-\s](?<mF>{_MONTH})\.?[-,\s]\s*(?<yF>\d{{4}})",
        rf"(?<mG>{_MONTH})\.?\s+(?<dG>\d{{1,2}}),?\s+(?<yG>\d{{4}})",
        r"(?<yH>\d{4})(?<mH>\d{2})(?<dH>\d{2})",
    ]
)
_TIME = (
    r"(?:(?<hI>\d{1,2}):(?<iI>\d{2})(?::(?<sI>\d{2})(?:[.,](?<fI>\d{1,9}))?)?(?:\s*(?<aI>[ap])\.?m\b\.?)?"
    r"|(?<hJ>\d{2})(?<iJ>\d{2})(?<sJ>\d{2})?)"
)
_ZONE = (
    rf"(?:\s*(?:(?<zK>{'|'.join(ABBREVIATIONS)})(?![a-z])|(?<oK>[+-]\d{{2}}(?::?\d{{2}})?)|(?<wK>[a-z][a-z0-9_+-]*(?:/[a-z0-9_+-]+){{0,2}})))?"
)
_CALENDAR_DIGITS = r"(?<yL>\d{4})(?<mL>\d{2})(?<dL>\d{2})(?<hL>\d{2})(?<iL>\d{2})(?<sL>\d{2})"
# Seconds up to 11 digits, then milliseconds, from 15 microseconds, from 18 nanoseconds; 14 are a calendar time alone.
_UNIX_DIGITS = r"(?<uM>\d{9,13}|\d{15,18}|[1-8]\d{18})"

#: Whole values: a date with a time, or digits alone.
INSTANT_PATTERN = rf"(?i)\A\s*(?:(?:{_DATE})(?:t|\s+){_TIME}{_ZONE}|{_CALENDAR_DIGITS}|{_UNIX_DIGITS})\s*\z"
#: A time of day alone.
CLOCK_PATTERN = rf"(?i)\A\s*{_TIME}{_ZONE}\s*\z"

_FIELDS = "y m d n h i s f a z o w u".split()
DAY_US = 86_400_000_000


def _components(value: Column, pattern: str) -> Column:
    """Array of the fields of _FIELDS, '' where absent; all are '' where the pattern doesn't match."""
    # By number, which Java puts in faster than a name; all groups that capture are named.
    names = re.findall(r"\(\?<([a-z][A-Z])>", pattern)
    joined = "|".join("".join(f"${i}" for i, g in enumerate(names, 1) if g[0] == kind) for kind in _FIELDS)
    return F.split(F.regexp_replace(value, rf"{pattern}|\A(?s:.*)\z", joined), r"\|", -1)


def _number(parts: Column, kind: str, kept: str = "int") -> Column:
    """A component as a number. The pattern lets digits alone through; a failing cast, even a try_cast, would cost microseconds."""
    digits = parts[_FIELDS.index(kind)]
    return F.when(digits != "", digits.cast(kept))


def _text(parts: Column, kind: str) -> Column:
    return F.lower(parts[_FIELDS.index(kind)])


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a valid date of the years 1 to 9999; years begin in March, so February comes last."""
    shifted = y - F.when(m <= 2, 1).otherwise(0)
    month = F.when(m > 2, m - 3).otherwise(m + 9)
    whole = lambda a, b: (a - a % b) / b
    days = shifted * 365 + whole(shifted, 4) - whole(shifted, 100) + whole(shifted, 400)
    return (days + whole(month * 153 + 2, 5) + d - 1 - 719_468).cast("bigint")


def _seconds(h: Column, i: Column, s: Column, half: Column) -> Column:
    """Seconds of the day, null where the clock is out of range."""
    hour = F.when(half == "", F.when(h.between(0, 23), h)).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    return F.when(i.between(0, 59) & F.coalesce(s, F.lit(0)).between(0, 59), hour * 3600 + i * 60 + F.coalesce(s, F.lit(0)))


def _hours_minutes(offset: Column) -> tuple[Column, Column]:
    """Of +hh, +hhmm and +hh:mm."""
    return F.substring(offset, 2, 2).cast("int"), F.when(F.length(offset) > 3, F.substring(offset, -2, 2).cast("int")).otherwise(0)


def _offset(offset: Column, name: Column) -> Column:
    """Offset in minutes, null without one."""
    hours, rest = _hours_minutes(offset)
    return F.when(offset != "", (hours * 60 + rest) * F.when(offset.startswith("-"), -1).otherwise(1)).when(name != "", _looked_up(ABBREVIATIONS, name))


def _true_offset(offset: Column) -> Column:
    """Whether an offset's text, if there is one, is within 14 hours, its minutes below 60."""
    hours, rest = _hours_minutes(offset)
    return (offset == "") | ((rest < 60) & (hours * 60 + rest <= 14 * 60))


#: Zone names lie in so many groups by a checksum, so that a name is sought among a few of some six hundred.
ZONE_GROUPS = 64


def _looked_up(table: dict, key: Column) -> Column:
    """The key's value in a small table, or null.

    A lambda also ends the span of whole-stage code, on purpose: as one span, all steps would be a single method, too long
    for the JVM to compile, and run at half the speed.
    """
    return F.get(F.filter(F.expr("array(" + ", ".join(f"named_struct('k', '{k}', 'v', {v!r})" for k, v in table.items()) + ")"), lambda x: x["k"] == key), 0)["v"]


@lru_cache(maxsize=1)
def _zone_groups() -> str:
    """Per group its zones as ``|lower case=name|``, groups apart by semicolons: all names of zones that the JVM knows, which
    is the public list of zones, as it ships it."""
    found = SparkSession.active()._jvm.java.util.ArrayList(SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds())
    groups = ["|"] * ZONE_GROUPS
    for zone in sorted(n for n in found if not n.startswith("SystemV/")):
        groups[zlib.crc32(zone.lower().encode()) % ZONE_GROUPS] += f"{zone.lower()}={zone}|"
    return ";".join(groups)


def _zone(name: Column) -> Column:
    """The zone of a name in lower case, or null if there is none."""
    group = F.get(F.split(F.lit(_zone_groups()), ";"), (F.crc32(name.cast("binary")) % ZONE_GROUPS).cast("int"))
    # As it does for abbreviations, a lambda ends the span of code, and computes the group once.
    find = lambda g: F.when(F.position(F.concat(F.lit("|"), name, F.lit("=")), g) > 0, F.substring(g, F.position(F.concat(F.lit("|"), name, F.lit("=")), g) + F.length(name) + 2, F.length(name)))
    return F.get(F.transform(F.array(group), find), 0)


def clock_seconds(value: Column) -> Column:
    """Seconds of the day that a text names as written, its offset or zone aside: hour 0-23, or 1-12 with AM or PM, minute and
    second 0-59. Null for null and for all else, an unknown zone or an impossible offset included."""
    def seconds(parts: Column) -> Column:
        zone = F.lower(parts[_FIELDS.index("w")])
        known = (zone == "") | _zone(zone).isNotNull()
        return F.when(known & _true_offset(parts[_FIELDS.index("o")]), _seconds(_number(parts, "h"), _number(parts, "i"), _number(parts, "s"), _text(parts, "a")))

    # A lambda's variable is computed once; written out, the match would stand, and run, in every branch.
    return F.when(value.isNotNull(), F.get(F.transform(F.array(_components(value, CLOCK_PATTERN)), seconds), 0))


def _shifted(us: Column, zone: Column, usual: str) -> Column:
    """Wall-clock microseconds in a zone at an instant; the usual zone is a literal, so it isn't looked up row by row."""
    at = F.timestamp_micros(us)
    own = at if usual == "Etc/UTC" else F.from_utc_timestamp(at, F.lit(usual))
    return F.unix_micros(F.when(zone == usual, own).otherwise(F.from_utc_timestamp(at, zone)))


def with_instant(df: DataFrame, value: Column, default_zone: str, prefix: str = "t", lenient: bool = False) -> DataFrame:
    """Adds ``<prefix>_utc_us bigint`` and ``<prefix>_status string``.

    status: ``ok``; ``absent`` (null or blank); ``unreadable`` (no notation, or out of the calendar's or clock's range);
    ``unknown_zone``; ``skipped`` and ``repeated`` (the wall clock names no or two instants). Only ``ok`` has an instant.
    A value without offset or zone is wall clock of ``default_zone``; any zone the JVM knows may be named, in any case; an
    offset beyond 14 hours or with 60 minutes or more is unreadable. Extra columns stay; those of the two names, and
    those beginning ``_<prefix>_``, are replaced. lenient: ``skipped`` and ``repeated`` have the instant by the offset
    before the change, as to_utc_timestamp has it.
    """
    p = f"_{prefix}_"
    step = lambda df, *added: df.select("*", *(c.alias(p + n) for n, c in added))
    df = df.withColumn(p + "text", value)
    df = df.drop(*(c for c in df.columns if c.startswith(p) and c != p + "text"))
    df = step(df, ("parts", _components(F.col(p + "text"), INSTANT_PATTERN)))
    parts = F.col(p + "parts")
    name = F.substring(_text(parts, "m"), 1, 3)  # a number has at most two digits, a name at least three letters
    named_month = F.when(F.length(name) == 3, ((F.position(name, F.lit(MONTHS)) + 3) / 4).cast("int"))
    # Small steps: the code made for a large one would be too long for the JVM to compile.
    df = step(df, *((k, _number(parts, k)) for k in "ydn"), ("m", F.coalesce(named_month, F.when(F.length(name) < 3, _number(parts, "m")))))
    df = step(df, *((k, _number(parts, k)) for k in "his"), ("half", _text(parts, "a")))
    fraction = parts[_FIELDS.index("f")]
    df = step(
        df,
        ("seconds", _seconds(*(F.col(p + k) for k in ("h", "i", "s", "half"))).cast("bigint")),
        ("micro", F.when(fraction != "", F.rpad(fraction, 6, "0").cast("int")).otherwise(0)),
    )
    df = step(
        df,
        ("offset", _offset(parts[_FIELDS.index("o")], _text(parts, "z")).cast("bigint")),
        ("unix", _number(parts, "u", "bigint")),
        ("digits", F.length(parts[_FIELDS.index("u")])),
        ("named", F.lower(parts[_FIELDS.index("w")])),
        ("false_offset", ~_true_offset(parts[_FIELDS.index("o")])),
    )
    y, m, d, n = (F.col(p + k) for k in "ymdn")
    # A day of the year is that day of a long January.
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(n.isNotNull(), F.when(leap, 366).otherwise(365)).when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    df = step(df, ("length", length), ("date", F.coalesce(n, d)), ("month", F.when(n.isNotNull(), 1).otherwise(m)))
    month, date = F.col(p + "month"), F.col(p + "date")
    day = F.when((y >= 1) & month.between(1, 12) & date.between(1, F.col(p + "length")), days_from_civil(y, month, date))
    df = step(df, ("day", F.when(~F.col(p + "false_offset"), day)))
    wall = F.col(p + "day") * DAY_US + F.col(p + "seconds") * 1_000_000 + F.col(p + "micro")
    digits = F.col(p + "digits")
    unix = F.when(digits <= 17, F.col(p + "unix") * F.when(digits <= 11, 1_000_000).when(digits <= 14, 1_000).otherwise(1)).otherwise(F.floor(F.col(p + "unix") / 1_000).cast("bigint"))
    zone = F.when(F.col(p + "named") == "", F.lit(default_zone)).otherwise(_zone(F.col(p + "named")))
    df = step(df, ("wall", wall), ("instant", unix), ("zone", zone))
    wall, zone, offset = F.col(p + "wall"), F.col(p + "zone"), F.col(p + "offset")
    bare = F.col(p + "instant").isNull() & offset.isNull() & wall.isNotNull()
    # The zone's offset a day before and after; where they differ, a change is near and both are tried.
    before = F.when(bare, _shifted(wall - DAY_US, zone, default_zone) - (wall - DAY_US))
    after = F.when(bare, _shifted(wall + DAY_US, zone, default_zone) - (wall + DAY_US))
    df = step(df, ("before", before), ("after", after))
    before, after = F.col(p + "before"), F.col(p + "after")
    holds = lambda c: _shifted(wall - c, zone, default_zone) == wall
    near = before != after
    df = step(df, ("first", F.when(near, holds(before))), ("second", F.when(near, holds(after))))
    first, second = F.col(p + "first"), F.col(p + "second")
    local = F.when(~near | (first & ~second), wall - before).when(second & ~first, wall - after)
    known = F.coalesce(F.col(p + "instant"), wall - offset * 60_000_000, local)
    utc = F.coalesce(known, F.when(near, wall - before)) if lenient else known
    text = F.col(p + "text")
    status = (
        F.when(text.isNull() | (F.trim(text) == ""), "absent")
        .when(known.isNotNull(), "ok")
        .when(wall.isNull(), "unreadable")
        .when(zone.isNull(), "unknown_zone")
        .when(first & second, "repeated")
        .otherwise("skipped")
    )
    kept = [c for c in df.columns if not c.startswith(p) and c not in (f"{prefix}_utc_us", f"{prefix}_status")]
    # Made by a generator of one row, the two columns have no lineage: no filter is pushed through, which would repeat the
    # whole chain of steps in itself, and no optimiser rule follows a join key down the chain, which took a second a join.
    return df.select(*(F.col(f"`{c}`") for c in kept), F.inline(F.array(F.struct(utc.alias(f"{prefix}_utc_us"), status.alias(f"{prefix}_status")))))
