"""Queries of problem 1: every time as one UTC instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from city import reading_sql as R
from weftline.operators import instants
from weftline.sources.tables import table

SOURCES = {"taxi_trips": instants.trips, "weather": instants.weather, "air_quality": instants.air_quality}


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    parts = [instants.rewritten(f(table(spark, directory, t)), t) for t, f in SOURCES.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def p1_normalised(spark: SparkSession, directory: str) -> DataFrame:
    """Every row of the three tables with its instant, or the reason why it has none."""
    parts = [
        f(table(spark, directory, t)).select(F.lit(t).alias("table_name"), "row_id", F.col("t_utc_us").alias("utc_us"), F.col("t_status").alias("status"))
        for t, f in SOURCES.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


QUERIES = {"p1_found": p1_found, "p1_normalised": p1_normalised}

_ONE = lambda t, c, zone: f"""SELECT '{t}' AS t, row_id, {c} AS x, coalesce(regexp_full_match({c}, {R.PLAIN}), false) AS plain, {R.instant('', zone)} AS inst, {R.doubtful('', zone)} AS doubt FROM (SELECT row_id, {c}, {R.stamp(c)} FROM {t})"""
_AIR = f"""SELECT 'air_quality' AS t, row_id, trim(date_gmt) || ' ' || trim(time_gmt) AS x, coalesce(regexp_full_match(date_gmt, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND regexp_full_match(time_gmt, '\\d{{2}}:\\d{{2}}'), false) AS plain,
  {R.instant('', 'UTC')} AS inst, {R.doubtful('', 'UTC')} AS doubt FROM (SELECT row_id, date_gmt, time_gmt, {R.hour_stamp('date_gmt', 'time_gmt')} FROM air_quality)"""
_ALL = f"WITH a AS ({_ONE('taxi_trips', 'pickup_datetime', 'NY')} UNION ALL {_ONE('weather', 'observation_datetime', 'UTC')} UNION ALL {_AIR})"
SQL = {
    "p1_found": f"{_ALL} SELECT t AS table_name, row_id, CASE WHEN doubt IS NULL THEN epoch_us(inst) ELSE -1 END AS utc_us FROM a WHERE inst IS NOT NULL AND (NOT plain OR doubt IS NOT NULL)",
    "p1_normalised": f"{_ALL} SELECT t AS table_name, row_id, CASE WHEN doubt IS NULL THEN epoch_us(inst) END AS utc_us, CASE WHEN x IS NULL OR trim(x) = '' THEN 'absent' WHEN inst IS NULL THEN 'unreadable' ELSE coalesce(doubt, 'ok') END AS status FROM a",
}
