"""One query or more for each of the engine's own operators, over whole tables, with SQL that gives the same."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from city import reading_sql as R
from city import specs
from weftline.functions import columns as C
from weftline.operators import enrich, quality, standardize
from weftline.plans import ingest, integrate, layouts, products
from weftline.sources.shared import together
from weftline.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def classified(spark: SparkSession, d: str, name: str) -> DataFrame:
    spec = specs.ALL[name](f"{d}/{name}.parquet")
    return ingest.classified(table(spark, d, name), spec)


def clean(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ingest.clean(classified(spark, d, name), specs.ALL[name](f"{d}/{name}.parquet"))


# The same specifications in SQL.
_RULES = {
    "pickup:instant": "coalesce(p_ok, false)",
    "dropoff:instant": "coalesce(q_ok, false)",
    "trip_duration_minutes:range": "coalesce(minutes >= 0, false)",
    "pickup_location_id:present": "pickup_location_id IS NOT NULL",
    "dropoff_location_id:present": "dropoff_location_id IS NOT NULL",
    "passenger_count:range": "coalesce(passenger_count BETWEEN 0 AND 10, true)",
    "tip_amount:range": f"(tip_amount IS NULL OR {R.FINITE.format('tip_amount')})",
    "fare_amount:range": R.FINITE.format("fare_amount"),
    "total_amount:range": R.FINITE.format("total_amount"),
    "trip_distance:range": R.FINITE.format("trip_distance"),
}
_ERRORS = ", ".join(f"CASE WHEN NOT {good} THEN '{name}' END" for name, good in _RULES.items())
TRIPS = f"""
t0 AS (SELECT *, {R.stamp('pickup_datetime', '1')}, {R.stamp('dropoff_datetime', '2')} FROM taxi_trips),
t1 AS (SELECT *, {R.instant('1', 'NY')} AS pu, {R.instant('2', 'NY')} AS qu, {R.doubtful('1', 'NY')} AS p_doubt, {R.doubtful('2', 'NY')} AS q_doubt FROM t0),
t2 AS (SELECT *, round((floor(epoch(qu)) - floor(epoch(pu))) / 60.0, 2) AS minutes, pu IS NOT NULL AND coalesce(p_doubt, '') <> 'skipped' AS p_ok, qu IS NOT NULL AND coalesce(q_doubt, '') <> 'skipped' AS q_ok, timezone({R.NY}, pu) AS p FROM t1),
t3 AS (SELECT *, concat_ws(';', {_ERRORS}) AS errors FROM t2),
t4 AS (SELECT *, CASE WHEN errors = '' THEN row_number() OVER (PARTITION BY errors = '', vendor_id, pu, qu, pickup_location_id, dropoff_location_id, fare_amount, trip_distance ORDER BY row_id) ELSE 1 END AS rk FROM t3),
trips_judged AS (SELECT *, CASE WHEN errors <> '' THEN errors WHEN rk > 1 THEN 'duplicate_key' END AS reason FROM t4),
trips AS (SELECT *, p::date AS pickup_date, year(p) AS pickup_year, month(p) AS pickup_month, minutes AS trip_duration_minutes FROM trips_judged WHERE reason IS NULL)"""
_TITLE = "array_to_string([upper(w[1]) || w[2:] for w in string_split(lower(trim(borough)), ' ')], ' ')"
ZONES = f"""
z0 AS (SELECT location_id, {_TITLE} AS borough, trim(zone) AS zone, service_zone, listed_at FROM taxi_zones WHERE location_id IS NOT NULL AND trim(borough) <> ''),
zones AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY listed_at NULLS FIRST, zone NULLS FIRST, borough, service_zone NULLS FIRST) AS rk FROM z0) WHERE rk = 1)"""
AIR = f"""
a0 AS (SELECT *, CASE WHEN regexp_full_match(trim(county_code), '[+-]?\\d+') THEN try_cast(trim(county_code) AS INT) END AS county FROM air_quality),
a1 AS (SELECT *, CASE county WHEN 5 THEN 'Bronx' WHEN 47 THEN 'Brooklyn' WHEN 61 THEN 'Manhattan' WHEN 81 THEN 'Queens' WHEN 85 THEN 'Staten Island' END AS borough, {R.hour_stamp('date_gmt', 'time_gmt')}
  FROM a0 WHERE coalesce(state_code = 36 AND county IN (5, 47, 61, 81, 85), true)),
a2 AS (SELECT *, timezone('UTC', {R.instant('', 'UTC')}) AS seen FROM a1 WHERE coalesce({R.doubtful('', 'UTC')}, '') <> 'skipped'),
a3 AS (SELECT *, row_number() OVER (PARTITION BY state_code, county, site_number, poc, seen ORDER BY row_id) AS rk FROM a2
  WHERE seen IS NOT NULL AND sample_measurement_pm25 BETWEEN 0 AND 1000 AND CAST(sample_measurement_pm25 AS VARCHAR) <> 'nan' AND borough IS NOT NULL AND site_number IS NOT NULL AND poc IS NOT NULL),
air AS (SELECT * FROM a3 WHERE rk = 1),
sites AS (SELECT date_trunc('hour', seen) AS h, borough, state_code, county, site_number, avg(sample_measurement_pm25) AS m FROM air GROUP BY ALL),
levels AS (SELECT h, borough, avg(m) AS level FROM sites GROUP BY ALL),
city AS (SELECT h, avg(m) AS level FROM sites GROUP BY ALL)"""
_W = {"temperature_c": "-90 AND 60", "relative_humidity_pct": "0 AND 100"}
_W_OPTIONAL = {"air_pressure_hpa": "800 AND 1100", "cloud_cover_oktas": "0 AND 8", "weather_condition_code": "0 AND 1e300"}
_W_RULES = [f"{c} BETWEEN {r} AND CAST({c} AS VARCHAR) <> 'nan'" for c, r in _W.items()] + [R.FINITE.format("wind_speed_kmh"), f"(precipitation_mm IS NULL OR {R.FINITE.format('precipitation_mm')})"]
_W_RULES += [f"({c} IS NULL OR ({c} BETWEEN {r} AND CAST({c} AS VARCHAR) NOT IN ('nan', 'inf')))" for c, r in _W_OPTIONAL.items()]
WEATHER = f"""
w0 AS (SELECT * REPLACE (CASE WHEN regexp_full_match(trim(hour), '[+-]?\\d+') THEN try_cast(trim(hour) AS INT) END AS hour) FROM weather),
w1 AS (SELECT *, try_strptime(printf('%04d-%02d-%02d %02d', year, month, day, hour), '%Y-%m-%d %H') AS seen FROM w0 WHERE hour BETWEEN 0 AND 23 AND station_id IS NOT NULL AND {' AND '.join(_W_RULES)}),
w2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id, seen ORDER BY row_id) AS rk FROM w1 WHERE seen IS NOT NULL) WHERE rk = 1),
hours AS (SELECT seen AS h, avg(temperature_c) AS temperature_c, avg(relative_humidity_pct) AS relative_humidity_pct, avg(precipitation_mm) AS precipitation_mm, max(weather_condition_code) AS weather_condition_code,
  avg(wind_speed_kmh) AS wind_speed_kmh, avg(air_pressure_hpa) AS air_pressure_hpa, avg(cloud_cover_oktas) AS cloud_cover_oktas FROM w2 GROUP BY 1)"""


def ntz(c: str):
    return F.col(c).cast("timestamp_ntz")


@query("SELECT n_nationkey AS nation_key, n_name AS nation_name, n_regionkey FROM nation")
def q01_renamed(spark, d):
    return standardize.renamed(table(spark, d, "nation"), {"n_nationkey": "nation_key", "n_name": "nation_name"})


@query(r"""SELECT row_id, CASE WHEN regexp_full_match(trim(hour), '[+-]?\d+') THEN try_cast(trim(hour) AS INT) END AS hour,
 CASE WHEN hour IS NOT NULL AND NOT regexp_full_match(trim(hour), '[+-]?\d+') THEN 'invalid_type:hour' ELSE '' END AS errors FROM weather""")
def q02_safe_cast(spark, d):
    df = standardize.safe_cast(table(spark, d, "weather").select("row_id", "hour"), {"hour": "int"})
    return df.select("row_id", "hour", F.array_join("_cast_errors", ";").alias("errors"))


@query("""SELECT CASE WHEN NOT l_quantity BETWEEN 1 AND 40 THEN 'quantity' END AS a, CASE WHEN NOT l_discount <= 0.08 THEN 'discount' END AS b, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL""")
def q03_rules(spark, d):
    df = quality.with_errors(table(spark, d, "lineitem"), {"quantity": "l_quantity BETWEEN 1 AND 40", "discount": "l_discount <= 0.08"})
    has = lambda n: F.when(F.array_contains("_validation_errors", n), n)
    return df.groupBy(has("quantity").alias("a"), has("discount").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TRIPS} SELECT reason, CAST(count(*) AS BIGINT) AS n_rows FROM trips_judged WHERE reason IS NOT NULL GROUP BY reason")
def q04_reasons(spark, d):
    return quality.rejected(classified(spark, d, "taxi_trips")).groupBy(F.col("_rejection_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate) AS rk FROM lineitem) WHERE rk = 1""")
def q05_first_by_key(spark, d):
    df = quality.first_by_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate")])
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"WITH {TRIPS} SELECT CAST(count(*) AS BIGINT) AS scoped, CAST(count(*) FILTER (reason IS NULL) AS BIGINT) AS valid, CAST(count(reason) AS BIGINT) AS rejected, CAST(count(*) FILTER (reason = 'duplicate_key') AS BIGINT) AS duplicates FROM trips_judged")
def q06_account(spark, d):
    return quality.totals(classified(spark, d, "taxi_trips"))


@query(f"WITH {AIR} SELECT county, CAST(count(*) AS BIGINT) AS n FROM a1 GROUP BY county")
def q07_scope(spark, d):
    df = ingest.prepared(table(spark, d, "air_quality"), specs.air_quality(d))
    return df.groupBy(F.col("county_code").alias("county")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_id, coalesce(passenger_count, 1) AS passenger_count, coalesce(tolls_amount, 0.0) AS tolls_amount FROM taxi_trips")
def q08_defaults(spark, d):
    return standardize.with_defaults(table(spark, d, "taxi_trips").select("row_id", "passenger_count", "tolls_amount"), {"passenger_count": 1, "tolls_amount": 0.0})


@query("SELECT row_id, CASE WHEN location_id IS NULL THEN 'missing_key:location_id' ELSE '' END || CASE WHEN location_id IS NULL AND false THEN ';' ELSE '' END AS errors FROM (SELECT doc_id AS row_id, location_id FROM documents)")
def q09_missing_key(spark, d):
    df = quality.with_errors(table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "location_id"), {}, ["location_id"])
    return df.select("row_id", F.array_join("_validation_errors", ";").alias("errors"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' END AS status FROM orders")
def q10_mapped(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.mapped(F.col("o_orderstatus"), {"O": "open", "F": "final"}).alias("status"))


@query("SELECT event_id, CAST(ts AS DATE) AS ts_date, CAST(year(ts) AS INT) AS ts_year, CAST(month(ts) AS INT) AS ts_month, CAST(day(ts) AS INT) AS ts_day, CAST(hour(ts) AS INT) AS ts_hour FROM events")
def q11_calendar(spark, d):
    return table(spark, d, "events").select("event_id", *(c.alias(n) for n, c in C.calendar(F.col("ts"), "ts").items()))


@query("SELECT event_id, CAST(timezone('UTC', timezone('America/New_York', ts)) AS TIMESTAMP) AS utc, timezone('America/New_York', timezone('America/New_York', ts)) = ts AS exists_locally FROM events")
def q12_utc(spark, d):
    ts = F.col("ts").cast("timestamp")
    zone = "America/New_York"
    return table(spark, d, "events").select("event_id", C.utc_of(ts, zone).cast("timestamp_ntz").alias("utc"), C.local_exists(ts, zone).alias("exists_locally"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((epoch(l_shipdate) - epoch(o_orderdate)) / 60.0, 2) AS minutes FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q13_minutes(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", C.minutes_between(F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")).alias("minutes"))


@query("SELECT o_orderkey, sha256(concat_ws('||', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus)) AS id FROM orders")
def q14_hash_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.hash_key([F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus")]).alias("id"))


@query(r"""SELECT row_id, lpad(CAST(year AS VARCHAR), 4, '0') || '_' || lpad(CAST(month AS VARCHAR), 2, '0') || '_' || lpad(CAST(day AS VARCHAR), 2, '0') || '_' || lpad(h, 2, '0') AS id
 FROM (SELECT *, CASE WHEN regexp_full_match(trim(hour), '[0-9]+') THEN CAST(CAST(trim(hour) AS INT) AS VARCHAR) END AS h FROM weather)""")
def q15_calendar_key(spark, d):
    hour = F.when(F.trim("hour").rlike("^[0-9]+$"), F.trim("hour").cast("int"))
    return table(spark, d, "weather").select("row_id", C.calendar_key(F.col("year"), F.col("month"), F.col("day"), hour).alias("id"))


@query(f"""WITH {ZONES} SELECT t.row_id, coalesce(z.borough, 'Unknown') AS pickup_borough, coalesce(z.zone, 'Unknown') AS pickup_zone, z.service_zone AS pickup_service_zone, z.location_id IS NOT NULL AS pickup_zone_matched
 FROM taxi_trips t LEFT JOIN zones z ON t.pickup_location_id = z.location_id""")
def q16_zone_lookup(spark, d):
    names = {f"pickup_{c}": c for c in ("borough", "zone", "service_zone")}
    trips = table(spark, d, "taxi_trips").select("row_id", "pickup_location_id")
    df = enrich.looked_up(trips, enrich.lookup(clean(spark, d, "taxi_zones")), {"pickup_location_id": "location_id"}, names, "pickup_zone_matched")
    return enrich.labelled(df, ["pickup_borough", "pickup_zone"]).drop("pickup_location_id")


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS h, round(avg(value), 4) AS mean_value FROM events WHERE event_type = 'error' GROUP BY 1)
 SELECT event_id, mean_value, h IS NOT NULL AS matched, mean_value IS NULL AS value_missing FROM events LEFT JOIN w ON date_trunc('hour', ts) = h""")
def q17_hourly_lookup(spark, d):
    events = table(spark, d, "events").withColumn("_hour", C.hour_bucket(F.col("ts")))
    hourly = events.filter("event_type = 'error'").groupBy("_hour").agg(F.round(F.avg("value"), 4).alias("mean_value"))
    df = enrich.looked_up(events, enrich.lookup(hourly), {"_hour": "_hour"}, {"mean_value": "mean_value"}, "matched")
    return df.select("event_id", "mean_value", "matched", F.col("mean_value").isNull().alias("value_missing"))


def _sites(spark, d) -> DataFrame:
    hourly = clean(spark, d, "air_quality").withColumn("air_hour", C.hour_bucket(F.col("observation_datetime")))
    return enrich.unit_means(hourly, ["state_code", "county_code", "site_number"], ["air_hour", "borough"], "sample_measurement_pm25")


# Means are compared to 4 decimals after adding 1e-9, as ties are common and the engines differ in the last bit; the
# operators themselves round to 2 decimals without that.
@query(f"WITH {AIR} SELECT h AS air_hour, borough, site_number, round(m + 1e-9, 4) AS site_mean FROM sites")
def q18_site_means(spark, d):
    return _sites(spark, d).select(ntz("air_hour").alias("air_hour"), "borough", "site_number", F.round(F.col("unit_mean") + 1e-9, 4).alias("site_mean"))


@query(f"WITH {AIR} SELECT h AS air_hour, borough, round(level + 1e-9, 4) AS level FROM levels")
def q19_borough_means(spark, d):
    df = enrich.level_means(_sites(spark, d), ["air_hour", "borough"], "level", 12)
    return df.select(ntz("air_hour").alias("air_hour"), "borough", F.round(F.col("level") + 1e-9, 4).alias("level"))


@query(f"WITH {AIR} SELECT h AS air_hour, round(level + 1e-9, 4) AS level FROM city")
def q20_city_means(spark, d):
    df = enrich.level_means(_sites(spark, d), ["air_hour"], "level", 12)
    return df.select(ntz("air_hour").alias("air_hour"), F.round(F.col("level") + 1e-9, 4).alias("level"))


def _trips_and_context(spark, d) -> tuple[DataFrame, integrate.Context]:
    def known():
        return integrate.context(*together(*(partial(clean, spark, d, n) for n in ("taxi_zones", "weather", "air_quality"))), digits=12)

    return tuple(together(partial(clean, spark, d, "taxi_trips"), known))


def _end(e: str, at: str) -> str:
    """Joins of one end of the trips."""
    hour = f"date_trunc('hour', timezone('UTC', t.{at}))"
    return f""" LEFT JOIN zones z_{e} ON t.{e}_location_id = z_{e}.location_id LEFT JOIN hours h_{e} ON {hour} = h_{e}.h LEFT JOIN city c_{e} ON {hour} = c_{e}.h
 LEFT JOIN levels l_{e} ON {hour} = l_{e}.h AND l_{e}.borough = coalesce(z_{e}.borough, 'Unknown')"""


_JOINED = f"""j AS (SELECT t.*, coalesce(z_pickup.borough, 'Unknown') AS pickup_borough, z_pickup.location_id IS NOT NULL AS zone_matched, h_pickup.h IS NOT NULL AS weather_matched, l_pickup.level AS lb, c_pickup.level AS lc FROM trips t {_end('pickup', 'pu')})"""
_WITH = f"WITH {TRIPS}, {ZONES}, {AIR}, {WEATHER}"


def _enriched(spark, d) -> DataFrame:
    """Clean trips with the place, weather and air of their pickup."""
    trips, known = _trips_and_context(spark, d)
    return integrate.with_context(trips, "pickup", F.col("pickup_datetime"), known, True)


@query(f"""{_WITH}, {_JOINED} SELECT pickup_borough, CASE WHEN lb IS NOT NULL THEN 'borough' WHEN lc IS NOT NULL THEN 'citywide' ELSE 'missing' END AS source, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY ALL""")
def q21_fallback(spark, d):
    return _enriched(spark, d).groupBy("pickup_borough", F.col("pickup_pm25_source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'lost' AS side, CAST(row_id AS BIGINT) AS key FROM taxi_trips WHERE row_id NOT IN (SELECT row_id FROM integrated) UNION ALL SELECT 'new', row_id FROM integrated WHERE row_id NOT IN (SELECT row_id FROM taxi_trips)""")
def q22_anti_both_ways(spark, d):
    return enrich.key_differences(table(spark, d, "taxi_trips"), table(spark, d, "integrated"), "row_id")


@query("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_keys FROM lineitem")
def q23_distinct(spark, d):
    return enrich.key_counts(table(spark, d, "lineitem"), "l_orderkey")


@query(f"""{_WITH}, {_JOINED} SELECT CAST(count(*) FILTER (lb IS NOT NULL) AS BIGINT) AS pickup_pm25_source_borough_rows, CAST(count(*) FILTER (lb IS NULL AND lc IS NOT NULL) AS BIGINT) AS pickup_pm25_source_citywide_rows,
 CAST(count(*) FILTER (lb IS NULL AND lc IS NULL) AS BIGINT) AS pickup_pm25_source_missing_rows, CAST(count(*) FILTER (zone_matched) AS BIGINT) AS pickup_zone_matched_rows, CAST(count(*) FILTER (weather_matched) AS BIGINT) AS pickup_weather_matched_rows FROM j""")
def q24_coverage(spark, d):
    return enrich.coverage(_enriched(spark, d), ["pickup_pm25_source"], ["pickup_zone_matched", "pickup_weather_matched"], integrate.LABELS)


def _layout_query(name: str, rounded: tuple[str, ...] = ()):
    def run(spark, d):
        trips, zones = together(partial(clean, spark, d, "taxi_trips"), partial(clean, spark, d, "taxi_zones"))
        df = layouts.run_sql(spark, layouts.QUERIES[name], {"trips": trips, "zones": zones})
        return df.withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in rounded})

    return run


def _grouped(values: str, where: str = "") -> str:
    return f"WITH {TRIPS}, {ZONES} SELECT coalesce(z.borough, 'Unknown') AS pickup_borough, {values} FROM trips t LEFT JOIN zones z ON t.pickup_location_id = z.location_id {where} GROUP BY 1"


_COUNT, _FARE = "CAST(count(*) AS BIGINT) AS trip_count", "round(avg(fare_amount) + 1e-9, 4) AS avg_fare"
for _name, _of, _rounded, _sql in (
    ("q25_trips_per_borough", "trips_per_borough", (), _grouped(_COUNT)),
    ("q26_duration_per_day", "duration_per_day", ("avg_duration",), f"WITH {TRIPS} SELECT pickup_date, round(avg(trip_duration_minutes) + 1e-9, 4) AS avg_duration FROM trips GROUP BY 1"),
    ("q27_fare_per_borough", "fare_per_borough", ("avg_fare",), _grouped(_FARE)),
    ("q28_one_day", "one_day", ("avg_fare",), _grouped(f"{_COUNT}, {_FARE}", "WHERE pickup_date = DATE '2024-02-14'")),
    ("q29_one_month", "one_month", ("avg_fare",), _grouped(f"{_COUNT}, {_FARE}", "WHERE pickup_year = 2024 AND pickup_month = 2")),
):
    QUERIES[_name], SQL[_name] = _layout_query(_of, _rounded), _sql

_CONDITION = "CASE WHEN precipitation_mm > 0 THEN CASE WHEN temperature_c <= 0 THEN 'snow' ELSE 'rain' END WHEN temperature_c < 0 THEN 'freezing' WHEN precipitation_mm IS NULL AND temperature_c IS NULL THEN 'unknown' ELSE 'dry' END"


def _condition():
    return products.weather_condition("precipitation_mm", "temperature_c")


@query("SELECT pickup_location_id AS zone, strftime(observation_hour, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS trip_count FROM integrated GROUP BY 1, 2")
def q30_monthly_demand(spark, d):
    return products.monthly_demand(table(spark, d, "integrated"), "pickup_location_id", "observation_hour")


@query(f"""SELECT {_CONDITION} AS condition, round(avg(trip_distance) + 1e-9, 4) AS avg_distance, CAST(count(*) AS BIGINT) AS trip_count
 FROM integrated JOIN taxi_trips USING (row_id) WHERE {R.FINITE.format('trip_distance')} GROUP BY 1""")
def q31_distance_by_weather(spark, d):
    far = table(spark, d, "taxi_trips").filter("trip_distance >= 0 AND trip_distance < double('infinity')").select("row_id", "trip_distance")
    df = table(spark, d, "integrated").join(far, "row_id")
    return products.mean_by_condition(df, _condition(), "trip_distance", "avg_distance", 12).withColumn("avg_distance", F.round(F.col("avg_distance") + 1e-9, 4))


@query("""WITH h AS (SELECT CAST(floor(pm25_citywide / 2.5) AS INT) AS band, observation_hour, count(*) AS n FROM integrated WHERE pm25_citywide BETWEEN 0 AND 1000 GROUP BY 1, 2)
 SELECT band, CAST(sum(n) AS BIGINT) AS trip_count, CAST(count(*) AS BIGINT) AS n_hours, round(avg(n) + 1e-9, 4) AS trips_per_hour FROM h GROUP BY 1""")
def q32_demand_by_air(spark, d):
    df = products.demand_by_level(table(spark, d, "integrated").filter("pm25_citywide BETWEEN 0 AND 1000"), "pm25_citywide", "observation_hour")
    return df.withColumn("trips_per_hour", F.round(F.col("trip_count") / F.col("n_hours") + 1e-9, 4))


@query(f"""WITH h AS (SELECT pickup_location_id AS zone, {_CONDITION} AS condition, observation_hour AS hour, count(*) AS n FROM integrated GROUP BY ALL), r AS (SELECT zone, condition, sum(n) / count(*) AS rate FROM h GROUP BY ALL),
 s AS (SELECT zone, round(max(rate) - min(rate), 6) AS spread, CAST(count(*) AS BIGINT) AS n_conditions FROM r GROUP BY ALL)
 SELECT * FROM (SELECT zone, spread, n_conditions, CAST(row_number() OVER (ORDER BY spread DESC, zone NULLS LAST) AS INT) AS position FROM s) WHERE position <= 20""")
def q33_demand_variation(spark, d):
    return products.demand_variation(table(spark, d, "integrated"), "pickup_location_id", _condition(), "observation_hour", 20)


@query("""SELECT weekday, hour, trip_count FROM (SELECT *, row_number() OVER (PARTITION BY weekday ORDER BY trip_count DESC, hour) AS r FROM
 (SELECT CAST(dayofweek(observation_hour) + 1 AS INT) AS weekday, CAST(hour(observation_hour) AS INT) AS hour, CAST(count(*) AS BIGINT) AS trip_count FROM integrated GROUP BY 1, 2)) WHERE r = 1""")
def q34_peak_hours(spark, d):
    return products.peak_hours(table(spark, d, "integrated"), "observation_hour")


@query("""SELECT month, trip_count, trip_count - lag(trip_count) OVER (ORDER BY month) AS change, round((trip_count - lag(trip_count) OVER (ORDER BY month)) * 100.0::DOUBLE / lag(trip_count) OVER (ORDER BY month), 4) AS change_pct
 FROM (SELECT strftime(observation_hour, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS trip_count FROM integrated GROUP BY 1)""")
def q35_monthly_trend(spark, d):
    return products.monthly_trend(table(spark, d, "integrated"), "observation_hour")


@query("SELECT CAST(observation_hour AS DATE) AS day, CAST(count(*) AS BIGINT) AS trip_count, round(avg(temperature_c) + 1e-9, 4) AS avg_temperature_c FROM integrated GROUP BY 1")
def q36_daily_summary(spark, d):
    df = products.daily_summary(table(spark, d, "integrated").withColumn("temperature_c", F.col("temperature_c") + 1e-9), "observation_hour", ["temperature_c"])
    return df


@query("SELECT lower(trim(pickup_borough)) AS label, CAST(count(*) AS BIGINT) AS trip_count, round(avg(fare_amount) + 1e-9, 4) AS avg_fare_amount FROM integrated WHERE fare_amount BETWEEN 0 AND 5000 GROUP BY 1")
def q37_borough_summary(spark, d):
    df = table(spark, d, "integrated").filter("fare_amount BETWEEN 0 AND 5000").withColumns({"label": F.lower(F.trim("pickup_borough")), "fare_amount": F.col("fare_amount") + 1e-9})
    return products.label_summary(df, "label", ["fare_amount"])


@query("SELECT pickup_location_id AS label, CAST(count(*) AS BIGINT) AS trip_count, round(avg(trip_distance) + 1e-9, 4) AS avg_trip_distance FROM taxi_trips WHERE trip_distance BETWEEN 0 AND 500 GROUP BY 1")
def q38_zone_summary(spark, d):
    df = table(spark, d, "taxi_trips").filter("trip_distance BETWEEN 0 AND 500").withColumn("trip_distance", F.col("trip_distance") + 1e-9)
    return products.label_summary(df, "pickup_location_id", ["trip_distance"])


@query("SELECT row_id, pickup_location_id FROM taxi_trips WHERE pickup_location_id IS NOT NULL AND pickup_location_id NOT IN (SELECT location_id FROM taxi_zones WHERE location_id IS NOT NULL)")
def q39_missing_references(spark, d):
    return quality.missing_references(table(spark, d, "taxi_trips").select("row_id", "pickup_location_id"), "pickup_location_id", table(spark, d, "taxi_zones"), "location_id")


@query(f"WITH {TRIPS} SELECT r AS reason, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT unnest(string_split(reason, ';')) AS r FROM trips_judged WHERE reason IS NOT NULL) GROUP BY 1")
def q40_single_reasons(spark, d):
    return quality.reason_counts(classified(spark, d, "taxi_trips"))


_SQL_MEASURES = integrate.MEASURES | integrate.MORE_MEASURES


def _columns(e: str, more: bool) -> str:
    measures = (f"round(h_{e}.{c} + 1e-9, 4) AS {e}_{n}" for n, c in _SQL_MEASURES.items() if more or n in integrate.MEASURES)
    level = lambda x, n: f"round({x} + 1e-9, 4) AS {e}_{n}"
    return ", ".join([
        f"coalesce(z_{e}.borough, 'Unknown') AS {e}_borough", f"coalesce(z_{e}.zone, 'Unknown') AS {e}_zone", f"z_{e}.service_zone AS {e}_service_zone", f"z_{e}.location_id IS NOT NULL AS {e}_zone_matched",
        *measures, f"h_{e}.h IS NOT NULL AS {e}_weather_matched", f"h_{e}.precipitation_mm IS NULL AS {e}_precipitation_missing",
        level(f"l_{e}.level", "pm25_borough"), level(f"c_{e}.level", "pm25_citywide"), level(f"coalesce(l_{e}.level, c_{e}.level)", "pm25"),
        f"CASE WHEN l_{e}.level IS NOT NULL THEN 'borough' WHEN c_{e}.level IS NOT NULL THEN 'citywide' ELSE 'missing' END AS {e}_pm25_source",
    ])


@query(f"""{_WITH} SELECT t.row_id, {_columns('pickup', True)}, {_columns('dropoff', False)} FROM trips t {_end('pickup', 'pu')} {_end('dropoff', 'qu')}""")
def q41_integrated(spark, d):
    """Trips with the context of both ends; of the trips' own columns the id alone."""
    df = integrate.integrated(*_trips_and_context(spark, d))
    added = [c for c in df.columns if c.startswith(("pickup_", "dropoff_")) and c not in specs.trips("x").required and c not in R_CALENDAR]
    codes = {f"{e}_weather_code" for e in ("pickup", "dropoff")}
    return df.select("row_id", *(F.round(F.col(c) + 1e-9, 4).alias(c) if t == "double" or c in codes else F.col(c) for c, t in df.dtypes if c in added))


R_CALENDAR = tuple(f"pickup_{x}" for x in ("local_datetime", "date", "year", "month", "day", "hour"))


@query("""WITH h AS (SELECT observation_hour, count(*) AS n, avg(pm25_citywide) AS level FROM integrated WHERE pm25_citywide BETWEEN 0 AND 1000 AND CAST(pm25_citywide AS VARCHAR) <> 'nan' GROUP BY 1)
 SELECT CAST(count(*) AS BIGINT) AS n_hours, round(corr(n, level), 6) AS correlation FROM h""")
def q42_air_and_demand(spark, d):
    return products.level_correlation(table(spark, d, "integrated").filter("pm25_citywide BETWEEN 0 AND 1000"), "pm25_citywide", "observation_hour")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY '{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r = 1""")
def q43_first_by_json(spark, d):
    """Without a tie break the rows' JSON text decides between valid rows of one key."""
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return standardize.projected(quality.accepted(quality.classified(df, {"status": "o_orderstatus <> 'P'"}, ["o_custkey"])), None)


@query(f"WITH {WEATHER} SELECT h AS hour, {', '.join(f'round({c} + 1e-9, 4) AS {c}' for c in _SQL_MEASURES.values())} FROM hours")
def q44_hourly_weather(spark, d):
    df = integrate.hourly_weather(clean(spark, d, "weather"))
    return df.select(ntz("hour").alias("hour"), *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in _SQL_MEASURES.values()))
