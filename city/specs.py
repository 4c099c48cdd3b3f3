"""Specifications of the city tables: what makes a row usable follows from what is said of the tables' dirt."""

from __future__ import annotations

from weftline.operators import rules as R
from weftline.plans.spec import DatasetSpec

# County codes of the state's five boroughs in scope, and the state's code.
BOROUGHS = {5: "Bronx", 47: "Brooklyn", 61: "Manhattan", 81: "Queens", 85: "Staten Island"}
STATE = 36


def trips(path: str) -> DatasetSpec:
    """A trip sent again has another row_id, perhaps another notation, but the same instants, places, fare and distance."""
    return DatasetSpec(
        name="taxi_trips",
        format="parquet",
        source_path=path,
        timezone="America/New_York",
        required=("row_id", "vendor_id", "pickup_datetime", "dropoff_datetime", "passenger_count", "pickup_location_id", "dropoff_location_id", "trip_distance", "fare_amount", "total_amount", "tip_amount", "tolls_amount"),
        casts={c: "double" for c in ("trip_distance", "fare_amount", "total_amount", "tip_amount", "tolls_amount")} | {c: "int" for c in ("vendor_id", "passenger_count", "pickup_location_id", "dropoff_location_id")},
        defaults={"tolls_amount": 0.0},
        instants={"pickup": "pickup_datetime", "dropoff": "dropoff_datetime"},
        derived={"pickup_datetime": "_pickup_utc", "dropoff_datetime": "_dropoff_utc"}
        | R.local_calendar("pickup", "pickup_datetime", ":timezone")
        | {
            "trip_duration_minutes": R.minutes("pickup_datetime", "dropoff_datetime"),
            "trip_id": R.hash_of("vendor_id", "pickup_datetime", "dropoff_datetime", "pickup_location_id", "dropoff_location_id", "fare_amount", "trip_distance"),
        },
        rules=R.instant("pickup", "dropoff")
        | R.within("trip_duration_minutes", 0)
        | R.present("pickup_location_id", "dropoff_location_id")
        | R.within("passenger_count", 0, 10, optional=True)
        | R.within("tip_amount", 0, optional=True)
        | R.within("fare_amount", 0)
        | R.within("total_amount", 0)
        | R.within("trip_distance", 0),
        key=("trip_id",),
        tie_break=("row_id",),
        partition_by=("pickup_year", "pickup_month"),
    )


def weather(path: str) -> DatasetSpec:
    """By station and UTC hour; the hour is read as text, and impossible measures are outside what nature allows."""
    digits = lambda c, n: f"lpad(string({c}), {n}, '0')"
    stamp = f"concat({digits('year', 4)}, '-', {digits('month', 2)}, '-', {digits('day', 2)}, ' ', {digits('hour', 2)}, ':00:00')"
    return DatasetSpec(
        name="weather",
        format="parquet",
        source_path=path,
        required=("row_id", "station_id", "year", "month", "day", "hour", "temperature_c", "relative_humidity_pct", "precipitation_mm", "wind_speed_kmh", "air_pressure_hpa", "cloud_cover_oktas", "weather_condition_code"),
        casts={"year": "int", "month": "int", "day": "int", "hour": "int"},
        derived={"observation_datetime": f"try_to_timestamp({stamp})"},
        rules=R.within("hour", 0, 23)
        | R.present("station_id")
        | R.within("temperature_c", -90, 60)
        | R.within("relative_humidity_pct", 0, 100)
        | R.within("wind_speed_kmh", 0)
        | R.within("precipitation_mm", 0, optional=True)
        | R.within("air_pressure_hpa", 800, 1100, optional=True)
        | R.within("cloud_cover_oktas", 0, 8, optional=True)
        | R.within("weather_condition_code", 0, optional=True),
        key=("station_id", "observation_datetime"),
        tie_break=("row_id",),
        selected=("station_id", "observation_datetime", "year", "month", "day", "hour", "temperature_c", "relative_humidity_pct", "precipitation_mm", "wind_speed_kmh", "air_pressure_hpa", "cloud_cover_oktas", "weather_condition_code"),
    )


def air_quality(path: str) -> DatasetSpec:
    """By site, instrument and reported sample hour; an offset in the time holds for the date too."""
    return DatasetSpec(
        name="air_quality",
        format="parquet",
        source_path=path,
        required=("row_id", "state_code", "county_code", "site_number", "poc", "parameter_code", "date_gmt", "time_gmt", "sample_measurement_pm25"),
        casts={"county_code": "int", "sample_measurement_pm25": "double"},
        scope="state_code = :state AND county_code IN :counties",
        instants={"observation": "concat(trim(date_gmt), ' ', trim(time_gmt))"},
        derived={"borough": R.mapped(BOROUGHS, "county_code"), "observation_datetime": "_observation_utc"},
        rules=R.instant("observation") | R.within("sample_measurement_pm25", 0, 1000) | R.present("borough", "site_number"),
        parameters={"state": STATE, "counties": list(BOROUGHS)},
        key=("state_code", "county_code", "site_number", "poc", "observation_datetime"),
        tie_break=("row_id",),
        selected=("observation_datetime", "borough", "state_code", "county_code", "site_number", "parameter_code", "poc", "sample_measurement_pm25"),
    )


def zones(path: str) -> DatasetSpec:
    """The first listing of a location survives, so the lookup's key is unique."""
    return DatasetSpec(
        name="taxi_zones",
        format="parquet",
        source_path=path,
        required=("location_id", "borough", "zone", "service_zone"),
        casts={"location_id": "int"},
        derived={"borough": "initcap(trim(borough))", "zone": "trim(zone)"},
        rules=R.not_blank("borough"),
        key=("location_id",),
        tie_break=("listed_at", "zone", "borough", "service_zone"),
        selected=("location_id", "borough", "zone", "service_zone"),
    )


ALL = {"taxi_zones": zones, "weather": weather, "air_quality": air_quality, "taxi_trips": trips}
