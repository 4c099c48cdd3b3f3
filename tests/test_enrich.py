from datetime import datetime

import pytest
from pyspark.sql import functions as F

from city import specs
from weftline.operators import enrich, quality
from weftline.plans import ingest, integrate


@pytest.fixture(scope="module")
def context(spark):
    t = lambda d, h, m: datetime(2024, 1, d, h, m)
    trips = spark.createDataFrame([("a", t(1, 12, 30), t(1, 12, 45), 1, 2), ("b", t(2, 12, 30), t(2, 12, 45), 2, 1), ("c", t(1, 12, 0), t(1, 13, 0), 9, None)], "trip_id string, pickup_datetime timestamp, dropoff_datetime timestamp, pickup_location_id int, dropoff_location_id int")
    zones = spark.createDataFrame([(1, "Bronx", "A", "B"), (2, "Queens", "C", "D")], "location_id int, borough string, zone string, service_zone string")
    weather = spark.createDataFrame([(t(1, 12, 0), 5.0, 60.0, None, 3.0, 1000.0, 2, 1)], "observation_datetime timestamp, temperature_c double, relative_humidity_pct double, precipitation_mm double, wind_speed_kmh double, air_pressure_hpa double, cloud_cover_oktas int, weather_condition_code int")
    air = spark.createDataFrame([(t(1, 12, 0), "Bronx", 36, 5, 1, 12.0)], "observation_datetime timestamp, borough string, state_code int, county_code int, site_number int, sample_measurement_pm25 double")
    return trips, zones, weather, air


def joined(trips, *others):
    return integrate.integrated(trips, integrate.context(*others))


def test_context_of_both_ends(context):
    rows = {r["trip_id"]: r for r in joined(*context).collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    assert len(rows) == 3
    assert a["pickup_weather_matched"] and a["pickup_precipitation_missing"] and a["pickup_precipitation_mm"] is None
    assert (a["pickup_pm25"], a["pickup_pm25_source"]) == (12.0, "borough")
    assert (a["dropoff_pm25"], a["dropoff_pm25_source"], a["dropoff_pm25_borough"]) == (12.0, "citywide", None)
    assert not b["pickup_weather_matched"] and b["pickup_pm25_source"] == "missing" and b["pickup_pm25"] is None
    assert (c["pickup_borough"], c["pickup_zone"], c["pickup_service_zone"], c["pickup_zone_matched"]) == ("Unknown", "Unknown", None, False)
    assert c["pickup_pm25_source"] == "citywide" and "dropoff_wind_speed_kmh" not in c.__fields__ and a["pickup_wind_speed_kmh"] == 3.0
    found = integrate.context_coverage(joined(*context)).first()
    assert found["pickup_pm25_source_borough_rows"] == 1 and found["pickup_weather_matched_rows"] == 2 and found["pickup_zone_matched_rows"] == 2


def test_lookups_are_broadcast_by_their_own_size(spark, context):
    """Also where Spark's own threshold wouldn't have it; beyond the measured bound they are joined by a shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plan = joined(*context)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 6 and "SortMergeJoin" not in plan
        facts, small = spark.range(5).withColumnRenamed("id", "k"), spark.range(3).select(F.col("id").alias("k"), F.lit("x").alias("v"))
        for most, join in ((1 << 20, "BroadcastHashJoin"), (10, "SortMergeJoin")):
            df = enrich.looked_up(facts, enrich.lookup(small, most), {"k": "k"}, {"v": "v"})
            assert join in df._jdf.queryExecution().executedPlan().toString() and df.filter("v is null").count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_weather_of_all_stations(spark):
    t = datetime(2024, 1, 1, 12)
    rows = [(t, 1.0, 40.0, None, 3.0, None, 2, 1), (t, 3.0, 60.0, 0.5, 5.0, 1000.0, None, 7), (t, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "observation_datetime timestamp, temperature_c double, relative_humidity_pct double, precipitation_mm double, wind_speed_kmh double, air_pressure_hpa double, cloud_cover_oktas int, weather_condition_code int")
    (r,) = integrate.hourly_weather(df).collect()
    assert (r["temperature_c"], r["relative_humidity_pct"], r["precipitation_mm"], r["wind_speed_kmh"], r["air_pressure_hpa"], r["cloud_cover_oktas"], r["weather_condition_code"]) == (2.0, 50.0, 0.5, 4.0, 1000.0, 2.0, 7)


def test_equal_weight_of_sites(spark):
    rows = [("Bronx", 36, 5, 1, 1, 10.0), ("Bronx", 36, 5, 1, 2, 10.0), ("Bronx", 36, 5, 2, 1, 20.0), ("Manhattan", 36, 61, 1, 1, 30.0)]
    df = spark.createDataFrame(rows, "borough string, state_code int, county_code int, site_number int, poc int, sample_measurement_pm25 double").withColumn("observation_datetime", F.lit(datetime(2024, 1, 1, 12)))
    air = integrate.air_levels(df)
    assert {r["borough"]: r["level"] for r in air.borough.collect()} == {"Bronx": 15.0, "Manhattan": 30.0}
    assert [r["level"] for r in air.city.collect()] == [20.0]
    with pytest.raises(ValueError, match="complete site identifiers"):
        integrate.air_levels(df.drop("site_number"))


def test_identity(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert enrich.assert_same_keys(df, df, "id") == 2
    for bad in ([("a",)], [("a",), ("b",), ("b",)], [("a",), ("c",)], [("a",), (None,)]):
        with pytest.raises(ValueError):
            enrich.assert_same_keys(df, spark.createDataFrame(bad, "id string"), "id")
    other = spark.createDataFrame([("b",), ("c",)], "id string")
    assert sorted(map(tuple, enrich.key_differences(df, other, "id").collect())) == [("lost", "a"), ("new", "c")]


def test_lookup_keys_must_be_unique(spark):
    good = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert enrich.require_unique(good, ["a", "b"]) is good
    for bad in ([(1, 1), (1, 1)], [(None, 1)]):
        with pytest.raises(ValueError):
            enrich.require_unique(spark.createDataFrame(bad, "a int, b int"), ["a", "b"])


def test_lookup_with_clashing_names_and_nulls(spark):
    facts = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    lookup = spark.createDataFrame([(1, "z"), (2, "w")], "k int, v string")
    got = enrich.looked_up(facts, lookup, {"k": "k"}, {"found": "v"}, "hit").orderBy("v").collect()
    assert [tuple(r) for r in got] == [(1, "x", "z", True), (None, "y", None, False)]


def test_weather_specification(spark):
    base = {"row_id": 1, "station_id": 1, "year": 2024, "month": 1, "day": 1, "hour": "12", "temperature_c": 1.0, "relative_humidity_pct": 50.0, "precipitation_mm": None, "wind_direction_deg": 0, "wind_speed_kmh": 1.0, "air_pressure_hpa": None, "cloud_cover_oktas": None, "weather_condition_code": None}
    schema = "row_id long, station_id int, year int, month int, day int, hour string, temperature_c double, relative_humidity_pct double, precipitation_mm double, wind_direction_deg int, wind_speed_kmh double, air_pressure_hpa double, cloud_cover_oktas int, weather_condition_code int"
    changes = [{}, {"precipitation_mm": -1.0}, {"precipitation_mm": float("nan")}, {"air_pressure_hpa": float("inf")}, {"cloud_cover_oktas": 9}, {"weather_condition_code": -1}, {"hour": "24"}, {"hour": "x"}, {"temperature_c": None}]
    rows = [tuple({**base, "row_id": i, "station_id": i, **c}.values()) for i, c in enumerate(changes)]
    spec = specs.weather("/x")
    out = ingest.classified(spark.createDataFrame(rows, schema), spec)
    assert [r["row_id"] for r in quality.accepted(out).collect()] == [0]
    assert {r["row_id"]: r["_rejection_reason"] for r in out.collect()}[7].startswith("invalid_type:hour;hour:range")
    with pytest.raises(ValueError, match="missing required columns"):
        ingest.prepared(spark.createDataFrame(rows, schema).drop("hour"), spec)
