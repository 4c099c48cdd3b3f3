"""Trips with the place, weather and air of both their ends."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.columns import hour_bucket
from weftline.operators import enrich
from weftline.sources.shared import together

MEASURES = {"temperature_c": "temperature_c", "humidity_pct": "relative_humidity_pct", "precipitation_mm": "precipitation_mm", "weather_code": "weather_condition_code"}
#: Of the first end alone.
MORE_MEASURES = {"wind_speed_kmh": "wind_speed_kmh", "pressure_hpa": "air_pressure_hpa", "cloud_cover": "cloud_cover_oktas"}
#: Codes are ranks of severity, so the highest of an hour stands; all other measures are means.
HIGHEST = ("weather_condition_code",)
LABELS = ("borough", "citywide", "missing")


@dataclass(frozen=True)
class Air:
    """Hourly levels: of a borough, and of the city, both means over sites."""

    borough: DataFrame
    city: DataFrame


@dataclass(frozen=True)
class Context:
    """What trips are joined with: places by id, and by UTC hour the weather and the air; each computed once and measured."""

    zones: DataFrame
    hours: DataFrame
    borough_hours: DataFrame


def air_levels(readings: DataFrame, at: str = "observation_datetime", value: str = "sample_measurement_pm25", digits: int = 2) -> Air:
    hourly = readings.withColumn("air_hour", hour_bucket(F.col(at)))
    sites = enrich.unit_means(hourly, ["state_code", "county_code", "site_number"], ["air_hour", "borough"], value)
    return Air(enrich.level_means(sites, ["air_hour", "borough"], "level", digits), enrich.level_means(sites, ["air_hour"], "level", digits))


def hourly_weather(weather: DataFrame) -> DataFrame:
    """One row per UTC hour: the mean of each measure over all stations that have it, and the highest code."""
    values = [*MEASURES.values(), *MORE_MEASURES.values()]
    return weather.groupBy(hour_bucket(F.col("observation_datetime")).alias("hour")).agg(*((F.max(c) if c in HIGHEST else F.avg(c)).alias(c) for c in values))


def context(zones: DataFrame, weather: DataFrame, readings: DataFrame, digits: int = 2) -> Context:
    """Hours and boroughs are few whatever the number of stations and sites, and none depends on the number of trips."""
    air = air_levels(readings, digits=digits)
    hours = hourly_weather(weather).withColumn("has_weather", F.lit(True))
    hours = hours.join(air.city.withColumnRenamed("air_hour", "hour"), "hour", "full")
    places = zones.select("location_id", "borough", "zone", "service_zone")
    return Context(*together(*(partial(enrich.lookup, df) for df in (places, hours, air.borough))))


def with_context(trips: DataFrame, end: str, at: Column, known: Context, more: bool) -> DataFrame:
    """Adds the context of one end of the trips: its place, and what the hour was like.

    All lookups are joined by equal keys, without a shuffle of the trips as long as their measured size lets them be broadcast.
    ``<end>_zone_matched`` tells a place without a label from one that isn't known.
    """
    df = trips.withColumn("_hour", hour_bucket(at))
    places = {f"{end}_borough": "borough", f"{end}_zone": "zone", f"{end}_service_zone": "service_zone"}
    df = enrich.looked_up(df, known.zones, {f"{end}_location_id": "location_id"}, places, f"{end}_zone_matched")
    df = enrich.labelled(df, [f"{end}_borough", f"{end}_zone"])
    names = {f"{end}_{n}": c for n, c in (MEASURES | (MORE_MEASURES if more else {})).items()}
    df = enrich.looked_up(df, known.hours, {"_hour": "hour"}, names | {f"{end}_weather_matched": "has_weather", f"{end}_pm25_citywide": "level"})
    df = df.withColumns({f"{end}_weather_matched": F.coalesce(f"{end}_weather_matched", F.lit(False)), f"{end}_precipitation_missing": F.col(f"{end}_precipitation_mm").isNull()})
    df = enrich.looked_up(df, known.borough_hours, {"_hour": "air_hour", f"{end}_borough": "borough"}, {f"{end}_pm25_borough": "level"})
    return enrich.with_fallback(df, {"borough": f"{end}_pm25_borough", "citywide": f"{end}_pm25_citywide"}, f"{end}_pm25").drop("_hour")


def integrated(trips: DataFrame, known: Context) -> DataFrame:
    df = with_context(trips, "pickup", F.col("pickup_datetime"), known, True)
    return with_context(df, "dropoff", F.col("dropoff_datetime"), known, False)


def context_coverage(df: DataFrame) -> DataFrame:
    return enrich.coverage(df, ["pickup_pm25_source", "dropoff_pm25_source"], ["pickup_weather_matched", "dropoff_weather_matched", "pickup_zone_matched", "dropoff_zone_matched"], LABELS)
