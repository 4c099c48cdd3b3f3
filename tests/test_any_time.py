"""The specifications read times in every notation of problem 1."""

from city import engine, specs
from weftline.operators import quality
from weftline.plans import ingest

SCHEMA = "row_id long, vendor_id int, pickup_datetime string, dropoff_datetime string, passenger_count int, pickup_location_id int, dropoff_location_id int, trip_distance double, fare_amount double, total_amount double, tip_amount double, tolls_amount double"
PICKUPS = ["2024-02-01 10:00:00", "02/01/2024 10:00:00 AM", "2024-02-01T15:00:00Z", "2024-02-01T10:00:00-0500", "1706799600", "01.02.2024 10:00", "N/A", None, "2024-03-10 02:30:00"]


def trips(spark):
    rows = [(i, 1, t, "2024-02-01 10:30:00", 1, 1, 2, 1.0, 5.0 + i, 6.0, 0.0, 0.0) for i, t in enumerate(PICKUPS)]
    rows.append((20, 1, "11/03/2024 01:30:00 AM", "2024-11-03 03:00:00", 1, 1, 2, 1.0, 1.0, 6.0, 0.0, 0.0))
    return spark.createDataFrame(rows, SCHEMA)


def test_trips_of_any_notation(spark):
    out = {r["row_id"]: r for r in ingest.classified(trips(spark), specs.trips("/x")).collect()}
    for i in range(6):
        assert out[i]["_rejection_reason"] is None and out[i]["trip_duration_minutes"] == 30.0 and out[i]["pickup_hour"] == 10
        assert str(out[i]["pickup_local_datetime"]) == "2024-02-01 10:00:00"
    assert all("pickup:instant" in out[i]["_rejection_reason"] for i in (6, 7, 8))
    # Of a repeated clock the first instant holds: 01:30 EDT to 03:00 EST.
    assert out[20]["trip_duration_minutes"] == 150.0 and out[20]["_rejection_reason"] is None


def test_air_of_any_notation(spark):
    stamps = [("2024-02-01", "15:00"), ("02/01/2024", "3:00 PM"), ("20240201", "1500"), ("2024-02-01", "10:00 EST"), ("2024-032", "15:00Z"), ("2024-02-01", "25:00"), (None, "15:00")]
    rows = [(i, 36, "5", 100 + i, 1, 88101, d, t, 9.0) for i, (d, t) in enumerate(stamps)]
    df = spark.createDataFrame(rows, "row_id long, state_code int, county_code string, site_number int, poc int, parameter_code int, date_gmt string, time_gmt string, sample_measurement_pm25 double")
    got = quality.accepted(ingest.classified(df, specs.air_quality("/x"))).collect()
    assert sorted(r["row_id"] for r in got) == [0, 1, 2, 3, 4] and {str(r["observation_datetime"]) for r in got} == {"2024-02-01 15:00:00"}


def test_integrated_has_every_valid_trip(spark, small):
    n = engine.QUERIES["q06_account"](spark, small).first()["valid"]
    assert engine.QUERIES["q41_integrated"](spark, small).count() == n > 0
