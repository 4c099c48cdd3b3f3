"""Queries of problems 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import rejects
from weftline.operators.dense_keys import per_key, regroup
from weftline.sources.shared import kept
from weftline.sources.tables import table

# The fields of the two kinds of files.
LAYOUTS = {
    "weather": ["year", "month", "day", "hour", "temp", "rhum", "prcp", "wdir", "wspd", "pres", "cldc", "coco"],
    "air_quality": [
        "State Code", "County Code", "Site Num", "Parameter Code", "POC", "Latitude", "Longitude", "Parameter Name",
        "Date Local", "Time Local", "Date GMT", "Time GMT", "Sample Measurement", "Units of Measure", "State Name",
        "County Name",
    ],
}
#: Of each column of the tables that files may hold too: the field of the file, and the type it is loaded as.
WEATHER = {"year": ("year", "int"), "month": ("month", "int"), "day": ("day", "int"), "temperature_c": ("temp", "double"), "relative_humidity_pct": ("rhum", "double"), "precipitation_mm": ("prcp", "double"),
           "wind_direction_deg": ("wdir", "int"), "wind_speed_kmh": ("wspd", "double"), "air_pressure_hpa": ("pres", "double"), "cloud_cover_oktas": ("cldc", "int"), "weather_condition_code": ("coco", "int")}
AIR = {"state_code": ("State Code", "int"), "site_number": ("Site Num", "int"), "parameter_code": ("Parameter Code", "int"), "poc": ("POC", "int"), "latitude": ("Latitude", "double"), "longitude": ("Longitude", "double"),
       "parameter_name": ("Parameter Name", "string"), "date_local": ("Date Local", "string"), "time_local": ("Time Local", "string"), "date_gmt": ("Date GMT", "string"), "sample_measurement_pm25": ("Sample Measurement", "double"),
       "units_of_measure": ("Units of Measure", "string"), "state_name": ("State Name", "string"), "county_name": ("County Name", "string")}


def _casts(hour: str | None, clock: str | None, county: str | None) -> list[rejects.Cast]:
    found = [(hour, "loaded_hour", "bad_hour", rejects.HOUR), (clock, "loaded_time_gmt_s", "bad_time_gmt", rejects.CLOCK), (county, "loaded_county_code", "bad_county_code", rejects.COUNTY)]
    return [rejects.Cast(*c) for c in found if c[0]]


def checked_lines(spark: SparkSession, directory: str, kept: list[str] | None = None) -> DataFrame:
    fields = list(dict.fromkeys(["hour", "Time GMT", "County Code", *(kept or [])]))
    lines = rejects.parse_lines(table(spark, directory, "raw_lines"), "row_id", "dataset", "line_text", LAYOUTS, fields)
    return rejects.with_casts(lines, _casts("hour", "Time GMT", "County Code"), F.col("structure"))


def checked_weather(spark: SparkSession, directory: str) -> DataFrame:
    return rejects.with_casts(table(spark, directory, "weather"), _casts("hour", None, None))


def checked_air(spark: SparkSession, directory: str) -> DataFrame:
    return rejects.with_casts(table(spark, directory, "air_quality"), _casts(None, "time_gmt", "county_code"))


CHECKS = {"weather": checked_weather, "air_quality": checked_air, "raw_lines": checked_lines}


def p5_rejects(spark: SparkSession, directory: str) -> DataFrame:
    """The rejected rows of the three tables with their reasons."""
    parts = [rejects.split_rows(f(spark, directory))[1].select(F.lit(t).alias("table_name"), F.col("row_id").cast("bigint").alias("row_id"), F.array_join("reasons", ";").alias("reason")) for t, f in CHECKS.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return p5_rejects(spark, directory).select("table_name", "row_id")


def p5_loaded(spark: SparkSession, directory: str) -> DataFrame:
    """The valid rows of all three tables with typed columns: the hour, seconds of the day of time_gmt as written and the county
    code as cast by the check, the other fields cast as far as they can be (null where not), those of the other kind null."""
    keep = {"loaded_hour": "hour", "loaded_time_gmt_s": "time_gmt_s", "loaded_county_code": "county_code"}

    def columns(df: DataFrame, name: str, dataset, names: dict, here: set[str], of_file: bool) -> DataFrame:
        typed = [(F.col(f"`{names[c][0] if of_file else c}`").try_cast(names[c][1]) if c in here else F.lit(None).cast(names[c][1])).alias(c) for c in names]
        cast = [(F.col(k) if k in df.columns else F.lit(None).cast("int")).alias(n) for k, n in keep.items()]
        return df.select(F.lit(name).alias("table_name"), F.col("row_id").cast("bigint").alias("row_id"), dataset.alias("dataset"), *cast, *typed)

    both = WEATHER | AIR
    lines = rejects.split_rows(checked_lines(spark, directory, [f for f, _ in both.values()]))[0]
    parts = [
        columns(rejects.split_rows(checked_weather(spark, directory))[0], "weather", F.lit("weather"), both, set(WEATHER), False),
        columns(rejects.split_rows(checked_air(spark, directory))[0], "air_quality", F.lit("air_quality"), both, set(AIR), False),
        columns(lines, "raw_lines", F.col("dataset"), both, set(both), True),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


MEASURES = ["fare_amount", "tip_amount", "trip_distance"]


def borough_groups(spark: SparkSession, directory: str) -> DataFrame:
    """The borough of each location, once: trimmed and lower case, the first by the alphabet if the rows differ."""
    name = F.lower(F.trim("borough"))
    zones = table(spark, directory, "taxi_zones").filter(F.col("location_id").isNotNull() & (name != ""))
    return zones.groupBy(F.col("location_id").alias("key")).agg(F.min(name).alias("group"))


def by_key(spark: SparkSession, directory: str, measures: list[str]) -> DataFrame:
    places = kept(per_key(table(spark, directory, "taxi_trips"), "pickup_location_id", measures))
    boroughs = regroup(places, borough_groups(spark, directory))
    all_rows = places.agg(F.sum("rows")).scalar()
    kinds = {"pickup_location_id": places, "borough": boroughs}
    parts = [d.withColumns({"key_kind": F.lit(k), "key_value": F.col("key").cast("string")}).drop("key") for k, d in kinds.items()]
    both = parts[0].unionByName(parts[1])
    return both.select("key_kind", "key_value", F.col("rows").alias("n_rows"), (F.col("rows") / all_rows).alias("share"), *(c for m in measures for c in (f"n_{m}", F.round(f"sum_{m}", 2).alias(f"sum_{m}"))))


def p6_by_key(spark: SparkSession, directory: str) -> DataFrame:
    """Counts and sums per pickup location and per borough, with the share of all trips."""
    return by_key(spark, directory, MEASURES)


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    least = F.when(F.col("key_kind") == "borough", 0.15).otherwise(0.03)
    return by_key(spark, directory, []).filter(F.col("key_value").isNotNull() & (F.col("share") >= least)).select("key_kind", "key_value")


QUERIES = {"p5_found": p5_found, "p5_rejects": p5_rejects, "p5_loaded": p5_loaded, "p6_found": p6_found, "p6_by_key": p6_by_key}

_HOUR = "(regexp_full_match({0}, ' *[0-9]+ *') AND try_cast(trim({0}) AS INT) BETWEEN 0 AND 23)"
_COUNTY = "(regexp_full_match({0}, ' *[0-9]+ *') AND try_cast(trim({0}) AS INT) BETWEEN 1 AND 999)"
_ZONE_TEXT = "( ?(Z|UTC|GMT|[ECMP][SD]T|[+-][0-9]{{2}}(:?[0-9]{{2}})?))?"
_CLOCK = f"regexp_full_match(upper({{0}}), ' *(([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\\.[0-9]+)?)?|(0?[1-9]|1[0-2]):[0-5][0-9](:[0-5][0-9](\\.[0-9]+)?)? ?[AP]M|([01][0-9]|2[0-3])[0-5][0-9]([0-5][0-9])?){_ZONE_TEXT} *')"
_FIELD = "regexp_replace(list_extract(f, {0}), '\"', '', 'g')"
_BAD = {"hour": f"{{0}} <> '' AND NOT {_HOUR}", "time": f"{{0}} <> '' AND NOT {_CLOCK}", "county": f"{{0}} <> '' AND NOT {_COUNTY}"}
_LINES = f"""WITH l AS (SELECT row_id, dataset, line_text, regexp_full_match(line_text, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS sound,
  CASE dataset WHEN 'weather' THEN 12 ELSE 16 END AS n, regexp_extract_all(line_text, '("([^"]|"")*"|[^",]*)(,|$)', 1) AS f, regexp_replace(line_text, '"([^"]|"")*"', '', 'g') AS bare FROM raw_lines),
 m AS (SELECT *, length(bare) - length(replace(bare, ',', '')) + 1 AS k FROM l),
 lines AS (SELECT *, CASE WHEN line_text IS NULL THEN 'no_line' WHEN NOT sound THEN 'broken_quoting' WHEN k <> n THEN 'field_count:' || k
  WHEN dataset = 'weather' THEN CASE WHEN {_BAD['hour'].format(_FIELD.format(4))} THEN 'bad_hour' ELSE '' END
  ELSE concat_ws(';', CASE WHEN {_BAD['time'].format(_FIELD.format(12))} THEN 'bad_time_gmt' END, CASE WHEN {_BAD['county'].format(_FIELD.format(2))} THEN 'bad_county_code' END) END AS reason FROM m),
 weathers AS (SELECT *, CASE WHEN hour IS NOT NULL AND NOT {_HOUR.format('hour')} THEN 'bad_hour' ELSE '' END AS reason FROM weather),
 airs AS (SELECT *, concat_ws(';', CASE WHEN time_gmt IS NOT NULL AND NOT {_CLOCK.format('time_gmt')} THEN 'bad_time_gmt' END, CASE WHEN county_code IS NOT NULL AND NOT {_COUNTY.format('county_code')} THEN 'bad_county_code' END) AS reason FROM air_quality)"""
_REJECTS = "SELECT 'weather' AS table_name, row_id, reason FROM weathers WHERE reason <> '' UNION ALL SELECT 'air_quality', row_id, reason FROM airs WHERE reason <> '' UNION ALL SELECT 'raw_lines', row_id, reason FROM lines WHERE reason <> ''"


def _seconds(c: str) -> str:
    """Seconds of the day of a valid clock."""
    x = f"upper({c})"
    part = lambda pattern: f"CAST(nullif(regexp_extract({x}, '{pattern}', 1), '') AS INT)"
    hour, minute = part(" *([0-9]{1,2}):"), part(" *[0-9]{1,2}:([0-9]{2})")
    second = f"coalesce({part(' *[0-9]{1,2}:[0-9]{2}:([0-9]{2})')}, 0)"
    half = f"CASE WHEN regexp_matches({x}, '[0-9] ?PM') THEN 12 ELSE 0 END"
    twelve = f"CASE WHEN regexp_matches({x}, '[0-9] ?[AP]M') THEN {hour} % 12 + {half} ELSE {hour} END"
    bare = f"CAST(trim({x})[1:2] AS INT) * 3600 + CAST(trim({x})[3:4] AS INT) * 60 + coalesce(CAST(nullif(regexp_extract(trim({x}), '^[0-9]{{4}}([0-9]{{2}})', 1), '') AS INT), 0)"
    return f"CAST(CASE WHEN {c} <> '' THEN CASE WHEN regexp_matches({x}, '^ *[0-9]{{1,2}}:') THEN ({twelve}) * 3600 + {minute} * 60 + {second} ELSE {bare} END END AS INT)"


def _number(c: str, kind: str) -> str:
    return {"int": f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN try_cast(trim({c}) AS INT) END", "double": f"try_cast(nullif(trim({c}), '') AS DOUBLE)", "string": f"nullif({c}, '')"}[kind]


def _line_field(field: str, kind: str) -> str:
    name = "weather" if field in LAYOUTS["weather"] else "air_quality"
    cell = f"replace(CASE WHEN f[{{0}}] LIKE '\"%' THEN f[{{0}}][2:-2] ELSE f[{{0}}] END, '\"\"', '\"')".format(LAYOUTS[name].index(field) + 1)
    return f"CASE WHEN dataset = '{name}' THEN {_number(cell, kind)} END"


def _loaded() -> str:
    both = WEATHER | AIR
    null = {"int": "NULL::INT", "double": "NULL::DOUBLE", "string": "NULL::VARCHAR"}
    own = lambda here: ", ".join((f"CAST({c} AS {'VARCHAR' if t == 'string' else t.upper()})" if c in here else null[t]) + f" AS {c}" for c, (_, t) in both.items())
    lines = ", ".join(f"{_line_field(*both[c])} AS {c}" for c in both)
    cell = lambda f, k: _line_field(f, "string") if k == "text" else ""
    of_line = f"CAST(trim({cell('hour', 'text')}) AS INT) AS hour, {_seconds('(' + cell('Time GMT', 'text') + ')')} AS time_gmt_s, CAST(trim({cell('County Code', 'text')}) AS INT) AS county_code"
    return f"""{_LINES} SELECT 'weather' AS table_name, row_id, 'weather' AS dataset, CAST(trim(hour) AS INT) AS hour, NULL::INT AS time_gmt_s, NULL::INT AS county_code, {own(WEATHER)} FROM weathers WHERE reason = ''
 UNION ALL SELECT 'air_quality', row_id, 'air_quality', NULL::INT, {_seconds('time_gmt')}, CAST(trim(county_code) AS INT), {own(AIR)} FROM airs WHERE reason = ''
 UNION ALL SELECT 'raw_lines', row_id, dataset, {of_line}, {lines} FROM lines WHERE reason = ''"""


SQL = {"p5_found": f"{_LINES} SELECT table_name, row_id FROM ({_REJECTS})", "p5_rejects": f"{_LINES} {_REJECTS}", "p5_loaded": _loaded()}
_PLACE = "SELECT location_id AS k, min(lower(trim(borough))) AS b FROM taxi_zones WHERE trim(borough) <> '' GROUP BY 1"
_GOOD = "CASE WHEN {0} IS NOT NULL AND CAST({0} AS VARCHAR) NOT IN ('nan', '-nan', 'inf', '-inf') THEN {0} END"
_SUMS = ", ".join(f"CAST(count({_GOOD.format(m)}) AS BIGINT) AS n_{m}, round(sum({_GOOD.format(m)}), 2) AS sum_{m}" for m in MEASURES)
SQL["p6_by_key"] = f"""WITH z AS ({_PLACE}), a AS (SELECT count(*) AS n FROM taxi_trips)
 SELECT 'pickup_location_id' AS key_kind, CAST(pickup_location_id AS VARCHAR) AS key_value, CAST(count(*) AS BIGINT) AS n_rows, count(*) / (SELECT n FROM a) AS share, {_SUMS} FROM taxi_trips GROUP BY pickup_location_id
 UNION ALL SELECT 'borough', b, CAST(count(*) AS BIGINT), count(*) / (SELECT n FROM a), {_SUMS} FROM taxi_trips LEFT JOIN z ON pickup_location_id = k GROUP BY b"""
SQL["p6_found"] = f"SELECT key_kind, key_value FROM ({SQL['p6_by_key']}) WHERE key_value IS NOT NULL AND share >= CASE key_kind WHEN 'borough' THEN 0.15 ELSE 0.03 END"
