"""Queries of problem 4: cells without a usable value, filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.impute import Category, Field, impute, with_group_mean, with_nested_means
from weftline.sources.tables import table

PASSENGERS, TIP, LEVEL = (0.0, 10.0), (0.0, float("inf")), (0.0, 1000.0)
ADDED = ["extra", "mta_tax", "tolls_amount", "improvement_surcharge", "congestion_surcharge", "airport_fee"]
#: Amounts and distances beyond these are no guide to a tip; they count as missing for the chain.
WIDEST = 1_000.0
# The rate codes and flags that trips may have.
RATE_CODES, FLAGS = ("1", "2", "3", "4", "5", "6"), ("N", "Y")


def _within(name: str, low: float, high: float) -> Column:
    return Field(name, F.col(name), low, high).usable()


def filled_trips(spark: SparkSession, directory: str) -> DataFrame:
    """Passenger counts and tips from each other, the charges, distance, kind of payment and pickup place."""
    trips = table(spark, directory, "taxi_trips").select("row_id", "pickup_location_id", "vendor_id", "passenger_count", "tip_amount", "trip_distance", "payment_type", "fare_amount", "total_amount", *ADDED)
    trips = with_group_mean(trips, [F.col("pickup_location_id")], _within("passenger_count", *PASSENGERS), "place_passengers")
    charges = F.col("fare_amount")
    for name in ADDED:
        charges = charges + F.coalesce(F.col(name), F.lit(0.0))
    fields = [
        Field("passenger_count", F.col("passenger_count"), *PASSENGERS, whole=True),
        Field("tip_amount", F.col("tip_amount"), *TIP),
        Field("balance", F.col("total_amount") - charges, -WIDEST, WIDEST, helper=True),
        Field("fare_amount", F.col("fare_amount"), 0.0, WIDEST, helper=True),
        Field("place_passengers", F.col("place_passengers"), *PASSENGERS, helper=True),
    ]
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    predictors = {"card": flag(F.col("payment_type") == 1), "cash": flag(F.col("payment_type") == 2), "vendor": flag(F.col("vendor_id") == 2), "distance": F.coalesce(_within("trip_distance", 0.0, WIDEST), F.lit(0.0))}
    return impute(trips, "row_id", fields, predictors)


def filled_levels(spark: SparkSession, directory: str) -> DataFrame:
    """Borough levels from the same borough and hour, the same borough and day, the whole city, and the weather."""
    rows = table(spark, directory, "integrated")
    level = _within("pm25_borough_level", *LEVEL)
    borough = F.lower(F.trim(F.col("pickup_borough")))
    hour, of = F.col("observation_hour"), {"like_borough": borough, "like_hour": F.col("observation_hour")}
    like, day = F.col("like_borough"), F.col("like_hour").cast("date")
    levels = {"borough_hour": [like, F.col("like_hour")], "borough_day": [like, day], "city_hour": [F.col("like_hour")]}
    rows = with_nested_means(rows, of, level, levels)
    fields = [
        Field("pm25_borough_level", F.col("pm25_borough_level"), *LEVEL),
        *(Field(n, F.col(n), *LEVEL, helper=True) for n in ("borough_hour", "borough_day", "city_hour", "pm25_citywide")),
        Field("temperature_c", F.col("temperature_c"), -60.0, 60.0, helper=True),
    ]
    angle = F.hour(hour) * (2 * 3.141592653589793 / 24)
    return impute(rows, "row_id", fields, {"cos_hour": F.cos(angle), "sin_hour": F.sin(angle)})


def _cells(df: DataFrame, name: str, fields: list[str]) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_value").alias("value"), F.col(f"{f}_filled").alias("filled")) for f in fields))
    return df.select(F.lit(name).alias("table_name"), F.col("row_id").cast("bigint").alias("row_id"), F.inline(cells))


def p4_filled(spark: SparkSession, directory: str) -> DataFrame:
    """Every cell of the three fields with its value, and whether it was filled."""
    trips = _cells(filled_trips(spark, directory), "taxi_trips", ["passenger_count", "tip_amount"])
    return trips.unionAll(_cells(filled_levels(spark, directory), "integrated", ["pm25_borough_level"]))


def filled_categories(spark: SparkSession, directory: str) -> DataFrame:
    """The rate code and the flag of trips, where null or no known value, from each other, vendor, payment, distance and fare."""
    trips = table(spark, directory, "taxi_trips").select("row_id", "vendor_id", "rate_code_id", "store_and_fwd_flag", "payment_type", "trip_distance", "fare_amount")
    fields = [Category("rate_code_id", F.col("rate_code_id"), RATE_CODES), Category("store_and_fwd_flag", F.col("store_and_fwd_flag"), FLAGS), Field("fare_amount", F.col("fare_amount"), 0.0, WIDEST, helper=True)]
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    predictors = {f"vendor{v}": flag(F.col("vendor_id") == v) for v in (2, 6)} | {"cash": flag(F.col("payment_type") == 2), "distance": F.coalesce(_within("trip_distance", 0.0, WIDEST), F.lit(0.0))}
    return impute(trips, "row_id", fields, predictors)


def p4_categories(spark: SparkSession, directory: str) -> DataFrame:
    """Every cell of the two categorical fields with its value, and whether it was filled."""
    return _cells(filled_categories(spark, directory), "taxi_trips", ["rate_code_id", "store_and_fwd_flag"])


def p4_category_masks(spark: SparkSession, directory: str) -> DataFrame:
    """The same, the filled cells without their values."""
    return p4_categories(spark, directory).withColumn("value", F.when(~F.col("filled"), F.col("value")))


def p4_masks(spark: SparkSession, directory: str) -> DataFrame:
    """Every cell of the three fields with its mask, and its value where it was usable."""
    return p4_filled(spark, directory).withColumn("value", F.when(~F.col("filled"), F.col("value")))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    filled = p4_filled(spark, directory).filter(F.col("filled") & F.col("value").isNotNull())  # every filled cell has a value
    return filled.select("table_name", "row_id", "field_name")


QUERIES = {"p4_found": p4_found, "p4_filled": p4_filled, "p4_masks": p4_masks, "p4_categories": p4_categories, "p4_category_masks": p4_category_masks}

# By the text of a number: statistics of the files, which leave NaN out, would let comparisons with it be folded.
_BAD = "SELECT '{0}' AS table_name, row_id, '{1}' AS field_name FROM {0} WHERE {1} IS NULL OR CAST({1} AS VARCHAR) IN ('nan', '-nan', 'inf', '-inf') OR NOT {1} BETWEEN {2} AND {3}"
SQL = {"p4_found": " UNION ALL ".join(_BAD.format(*x) for x in (("taxi_trips", "passenger_count", 0, 10), ("taxi_trips", "tip_amount", 0, "1e300"), ("integrated", "pm25_borough_level", 0, 1000)))}
_GOOD = "({1} IS NOT NULL AND CAST({1} AS VARCHAR) NOT IN ('nan', '-nan', 'inf', '-inf') AND {1} BETWEEN {2} AND {3})"
_CELL = "SELECT '{0}' AS table_name, row_id, '{1}' AS field_name, CASE WHEN " + _GOOD + " THEN CAST({1} AS DOUBLE) END AS value, NOT " + _GOOD + " AS filled FROM {0}"
SQL["p4_masks"] = " UNION ALL ".join(_CELL.format(*x) for x in (("taxi_trips", "passenger_count", 0, 10), ("taxi_trips", "tip_amount", 0, "1e300"), ("integrated", "pm25_borough_level", 0, 1000)))
_CATEGORY = "SELECT 'taxi_trips' AS table_name, row_id, '{0}' AS field_name, CASE WHEN {0} IN {1} THEN CAST({0} AS VARCHAR) END AS value, NOT coalesce({0} IN {1}, false) AS filled FROM taxi_trips"
SQL["p4_category_masks"] = " UNION ALL ".join(_CATEGORY.format(c, v) for c, v in (("rate_code_id", "(1, 2, 3, 4, 5, 6)"), ("store_and_fwd_flag", "('N', 'Y')")))
