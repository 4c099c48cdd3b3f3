"""Queries of problems 2 and 3."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import orphans
from weftline.operators.regular_grid import regular_grid
from weftline.sources.shared import kept, shared_folder
from weftline.sources.store import Store
from weftline.sources.tables import table
from weftline.streaming.incremental import OrphanTracker

FIELDS = ["pickup_location_id", "dropoff_location_id"]


def p2_grid(spark: SparkSession, directory: str) -> DataFrame:
    grid = regular_grid(table(spark, directory, "air_quality"), "site_number", "observation_datetime", "sample_measurement_pm25", 0.0, 1000.0)
    return grid.select(F.col("source").alias("site_number"), (F.col("hour") * 3600).alias("hour_start_s"), F.col("value").alias("pm25"), "n_readings", "status")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return p2_grid(spark, directory).filter(F.col("status") != "observed").select("site_number", "hour_start_s")


def p2_marks(spark: SparkSession, directory: str) -> DataFrame:
    """The grid without the values that were filled: which hours were seen, their means and numbers of readings."""
    grid = p2_grid(spark, directory)
    return grid.select("site_number", "hour_start_s", "n_readings", F.when(F.col("status") == "observed", F.round(F.col("pm25") + 1e-9, 4)).alias("pm25"), (F.col("status") == "observed").alias("seen"))


def months(df: DataFrame, at: str) -> list[str | None]:
    """Cuts between the months that occur; as many rows are fetched as there are months."""
    found = df.select(F.date_trunc("month", at).cast("timestamp_ntz").cast("string").alias("m")).filter("m is not null").distinct().collect()
    return [None, *sorted(r["m"] for r in found)[1:], None]


def _tracked(spark: SparkSession, directory: str, give: Callable[[OrphanTracker], DataFrame]) -> DataFrame:
    """What a tracker has after all months of arrival, one by one. Its tables are deleted, what it gives is kept."""
    trips = table(spark, directory, "taxi_trips")
    refs = orphans.references(trips, "row_id", FIELDS, "ingestion_timestamp")
    index = orphans.parent_index(table(spark, directory, "taxi_zones"), "location_id", "listed_at", "delisted_at")
    with shared_folder(spark, "orphans") as root:
        tracker = OrphanTracker(Store(spark, root))
        tracker.advance(refs, index, *months(trips, "ingestion_timestamp"))
        return kept(give(tracker))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """The references that the tracker opened, month by month: those that began to wait, or never had a parent."""
    opened = _tracked(spark, directory, OrphanTracker.opened)
    return opened.select(F.col("row_id").cast("bigint").alias("row_id"), "field_name", "kind", F.date_format("at", "yyyy-MM").alias("ingestion_month"))


def p3_snapshots(spark: SparkSession, directory: str) -> DataFrame:
    """What was opened, resolved and reopened in each month, and what waits at its end."""
    return _tracked(spark, directory, OrphanTracker.snapshots)


def p3_state(spark: SparkSession, directory: str) -> DataFrame:
    """Per field and location, how many references have arrived and how many wait after the last month."""
    return _tracked(spark, directory, OrphanTracker.state)


QUERIES = {"p2_found": p2_found, "p2_grid": p2_grid, "p2_marks": p2_marks, "p3_found": p3_found, "p3_snapshots": p3_snapshots, "p3_state": p3_state}

_HOURS = """SELECT DISTINCT site_number AS s, CAST(floor(epoch_us(observation_datetime) / 3600000000) AS BIGINT) AS h FROM air_quality
 WHERE site_number IS NOT NULL AND observation_datetime IS NOT NULL AND sample_measurement_pm25 BETWEEN 0 AND 1000"""
SQL = {
    "p2_found": f"""WITH u AS ({_HOURS}), g AS (SELECT s, unnest(range(min(h), max(h) + 1)) AS h FROM u GROUP BY s)
 SELECT s AS site_number, h * 3600 AS hour_start_s FROM g WHERE (s, h) NOT IN (SELECT (s, h) FROM u)""",
    "p3_found": """WITH r AS (SELECT row_id, 'pickup_location_id' AS field_name, pickup_location_id AS k, ingestion_timestamp AS t FROM taxi_trips
 UNION ALL SELECT row_id, 'dropoff_location_id', dropoff_location_id, ingestion_timestamp FROM taxi_trips),
 z AS (SELECT DISTINCT location_id AS k, listed_at, delisted_at FROM taxi_zones),
 j AS (SELECT r.row_id, field_name, t, count(z.k) AS n, coalesce(bool_or(listed_at <= t AND (delisted_at IS NULL OR t < delisted_at)), false) AS ok, coalesce(bool_or(delisted_at <= t), false) AS gone
 FROM r LEFT JOIN z USING (k) WHERE k IS NOT NULL GROUP BY r.row_id, field_name, t)
 SELECT row_id, field_name, CASE WHEN n = 0 THEN 'missing' WHEN gone THEN 'deleted' ELSE 'later' END AS kind, strftime(t, '%Y-%m') AS ingestion_month FROM j WHERE NOT ok""",
}
SQL["p2_marks"] = f"""WITH u AS ({_HOURS}), g AS (SELECT s, unnest(range(min(h), max(h) + 1)) AS h FROM u GROUP BY s),
 r AS (SELECT site_number AS s, CAST(floor(epoch_us(observation_datetime) / 3600000000) AS BIGINT) AS h, avg(sample_measurement_pm25) AS m, CAST(count(*) AS BIGINT) AS n FROM air_quality WHERE observation_datetime IS NOT NULL AND sample_measurement_pm25 BETWEEN 0 AND 1000 GROUP BY 1, 2)
 SELECT g.s AS site_number, g.h * 3600 AS hour_start_s, coalesce(n, 0) AS n_readings, round(m + 1e-9, 4) AS pm25, n IS NOT NULL AS seen FROM g LEFT JOIN r ON g.s = r.s AND g.h = r.h"""
_TRACKED = """WITH r AS (SELECT row_id, 'pickup_location_id' AS field_name, pickup_location_id AS k, ingestion_timestamp AS t FROM taxi_trips WHERE pickup_location_id IS NOT NULL
 UNION ALL SELECT row_id, 'dropoff_location_id', dropoff_location_id, ingestion_timestamp FROM taxi_trips WHERE dropoff_location_id IS NOT NULL),
 z AS (SELECT DISTINCT location_id AS k, listed_at AS a, delisted_at AS b FROM taxi_zones WHERE location_id IS NOT NULL),
 moments AS (SELECT k, a AS t FROM z WHERE a IS NOT NULL UNION SELECT k, b FROM z WHERE b IS NOT NULL),
 states AS (SELECT m.k, m.t, bool_or((a IS NULL OR a <= m.t) AND (b IS NULL OR m.t < b)) AS s, bool_or(a IS NULL) AS s0 FROM moments m JOIN z USING (k) GROUP BY ALL),
 changes AS (SELECT k, t, s FROM (SELECT *, coalesce(lag(s) OVER (PARTITION BY k ORDER BY t), s0) AS p FROM states) WHERE s <> p),
 c AS (SELECT field_name, k, t, count(*) AS n FROM r WHERE t IS NOT NULL GROUP BY ALL),
 kinds AS (SELECT field_name, c.k, c.t, n, CASE WHEN count(z.k) = 0 THEN 'missing' WHEN bool_or((a IS NULL OR a <= c.t) AND (b IS NULL OR c.t < b)) THEN NULL WHEN bool_or(coalesce(b <= c.t, false)) THEN 'deleted' ELSE 'later' END AS kind FROM c LEFT JOIN z ON c.k = z.k GROUP BY field_name, c.k, c.t, n)"""
SQL["p3_snapshots"] = f"""{_TRACKED},
 moves AS (SELECT field_name, strftime(t, '%Y-%m') AS month, 'opened_' || kind AS move, n FROM kinds WHERE kind IS NOT NULL
  UNION ALL SELECT field_name, strftime(e.t, '%Y-%m'), CASE WHEN s THEN 'resolved' ELSE 'reopened' END, n FROM changes e JOIN c ON c.k = e.k AND c.t < e.t),
 w AS (SELECT field_name, month, {', '.join(f"CAST(coalesce(sum(n) FILTER (move = '{m}'), 0) AS BIGINT) AS {m}" for m in ('opened_missing', 'opened_deleted', 'opened_later', 'resolved', 'reopened'))} FROM moves GROUP BY ALL)
 SELECT *, CAST(sum(opened_missing + opened_deleted + opened_later + reopened - resolved) OVER (PARTITION BY field_name ORDER BY month) AS BIGINT) AS pending FROM w"""
SQL["p3_state"] = f"""{_TRACKED}, e AS (SELECT k, bool_or(a IS NULL) AS s0 FROM z GROUP BY k), f AS (SELECT k, arg_max(s, t) AS s FROM changes GROUP BY k)
 SELECT field_name, CAST(c.k AS BIGINT) AS key, CAST(sum(n) AS BIGINT) AS n_arrived, CAST(CASE WHEN coalesce(f.s, e.s0, false) THEN 0 ELSE sum(n) END AS BIGINT) AS n_pending FROM c LEFT JOIN e ON c.k = e.k LEFT JOIN f ON c.k = f.k GROUP BY field_name, c.k, f.s, e.s0"""
