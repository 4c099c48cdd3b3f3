"""SQL for DuckDB that reads the notations of the test tables, shared by the queries that are compared with it."""

from __future__ import annotations

NY = "'America/New_York'"
OF_ZONE = r"(Z|GMT|UTC|EST|EDT|[+-]\d{2}:?\d{2}|America/New_York)"
STAMPS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%S.%f', '%m/%d/%Y %I:%M:%S %p', '%d.%m.%Y %H:%M', '%b %d, %Y %I:%M %p', '%a, %d %b %Y %H:%M:%S', '%Y%m%d%H%M%S']"
DATES = "['%Y-%m-%d', '%m/%d/%Y', '%Y%m%d', '%d-%b-%Y', '%d.%m.%Y', '%b %d, %Y', '%Y-%j']"
CLOCKS = "['%Y-%m-%d %H:%M', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H%M', '%Y-%m-%d %I:%M %p']"
PLAIN = r"'\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}'"
#: Finite and not negative, by the text of the number: statistics of the files, which leave NaN out, would let comparisons be folded.
FINITE = "({0} IS NOT NULL AND {0} >= 0 AND CAST({0} AS VARCHAR) NOT IN ('nan', '-nan', 'inf'))"


def minutes(z: str) -> str:
    """Offset of a zone's text."""
    return f"CAST(CASE {z} WHEN 'Z' THEN 0 WHEN 'GMT' THEN 0 WHEN 'UTC' THEN 0 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 ELSE try_cast({z}[1:3] AS INT) * 60 + try_cast({z}[1] || right({z}, 2) AS INT) END AS BIGINT)"


def stamp(c: str, n: str = "") -> str:
    """Columns z (zone as written), w (wall clock as written) and u (instant of Unix digits) of a whole time."""
    x = f"trim({c})"
    z = rf"CASE WHEN regexp_full_match({x}, '.*\d.*:\d{{2}}(\.\d+)? ?{OF_ZONE}') THEN regexp_extract({x}, '{OF_ZONE}$', 1) ELSE '' END AS z{n}"
    u = rf"CASE WHEN regexp_full_match({x}, '\d{{10}}') THEN make_timestamp(CAST({x} AS BIGINT) * 1000000) WHEN regexp_full_match({x}, '\d{{13}}') THEN make_timestamp(CAST({x} AS BIGINT) * 1000) END AS u{n}"
    w = f"CASE WHEN u{n} IS NULL THEN try_strptime(rtrim({x}[1:length({x}) - length(z{n})]), {STAMPS}) END AS w{n}"
    return f"{z}, {u}, {w}"


def hour_stamp(d: str, t: str, n: str = "") -> str:
    """The same of a date and a time apart."""
    z = rf"CASE WHEN regexp_full_match({t}, '.*\d ?{OF_ZONE}') THEN regexp_extract({t}, '{OF_ZONE}$', 1) ELSE '' END AS z{n}"
    w = f"try_strptime(trim({d}), {DATES}) + (try_strptime('2000-01-01 ' || trim(rtrim({t}[1:length({t}) - length(z{n})])), {CLOCKS}) - TIMESTAMP '2000-01-01') AS w{n}"
    return f"{z}, NULL::TIMESTAMP AS u{n}, {w}"


def of_wall(w: str) -> str:
    """The first instant of a wall clock in New York."""
    at = f"timezone({NY}, {w})"
    return f"CASE WHEN timezone({NY}, {at} - INTERVAL 1 HOUR) = {w} THEN {at} - INTERVAL 1 HOUR ELSE {at} END"


def instant(n: str, zone: str) -> str:
    """Instant of z, w, u as a time with zone, wall clock of ``zone`` (NY or UTC) without one; skipped wall clocks give one too."""
    z, w, u = (c + n for c in "zwu")
    bare = f"timezone('UTC', {w})" if zone == "UTC" else of_wall(w)
    return f"CASE WHEN {u} IS NOT NULL THEN timezone('UTC', {u}) WHEN {z} = 'America/New_York' THEN {of_wall(w)} WHEN {z} = '' THEN {bare} ELSE timezone('UTC', {w} - to_minutes({minutes(z)})) END"


def doubtful(n: str, zone: str) -> str:
    """NULL, 'skipped' or 'repeated': what a wall clock in New York is that names no or two instants."""
    z, w = "z" + n, "w" + n
    at = f"timezone({NY}, {w})"
    local = f"{z} IN ('', 'America/New_York')" if zone != "UTC" else f"{z} = 'America/New_York'"
    return f"CASE WHEN u{n} IS NULL AND {local} THEN CASE WHEN timezone({NY}, {at}) <> {w} THEN 'skipped' WHEN timezone({NY}, {at} - INTERVAL 1 HOUR) = {w} OR timezone({NY}, {at} + INTERVAL 1 HOUR) = {w} THEN 'repeated' END END"
