"""Mixed timestamp notations and zones brought to one UTC instant (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.temporal import with_instant

PLAIN_STAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"
PLAIN_DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
PLAIN_CLOCK = r"\A[0-9]{2}:[0-9]{2}\z"


def normalise(df: DataFrame, value: Column, default_zone: str, plain: Column) -> DataFrame:
    """Adds ``t_utc_us``, ``t_status`` (see with_instant) and ``t_plain`` to whole rows, without a shuffle.

    Rows are kept one for one: nulls, blanks and texts that name no time get a null instant and a status; repeated rows
    stay; an empty table gives an empty one. ``t_plain`` tells whether the value is written exactly in the plain form
    (false for null).
    """
    return with_instant(df.withColumn("t_plain", F.coalesce(plain, F.lit(False))), value, default_zone)


def rewritten(df: DataFrame, table: str) -> DataFrame:
    """Rows of normalise() whose value isn't plain, or names no or two instants: table_name, row_id, utc_us (-1 then)."""
    doubtful = F.col("t_status").isin("skipped", "repeated")
    return df.filter(doubtful | ((F.col("t_status") == "ok") & ~F.col("t_plain"))).select(
        F.lit(table).alias("table_name"), F.col("row_id").cast("bigint").alias("row_id"), F.when(doubtful, F.lit(-1).cast("bigint")).otherwise(F.col("t_utc_us")).alias("utc_us")
    )


def trips(df: DataFrame) -> DataFrame:
    """Pickups; without a zone they are New York wall clock."""
    v = F.col("pickup_datetime")
    return normalise(df, v, "America/New_York", v.rlike(PLAIN_STAMP))


def weather(df: DataFrame) -> DataFrame:
    v = F.col("observation_datetime")
    return normalise(df, v, "Etc/UTC", v.rlike(PLAIN_STAMP))


def air_quality(df: DataFrame) -> DataFrame:
    """Reported sample hours; an offset in the time holds for the date too. Without a date or a time there is none."""
    d, t = F.col("date_gmt"), F.col("time_gmt")
    return normalise(df, F.concat(F.trim(d), F.lit(" "), F.trim(t)), "Etc/UTC", d.rlike(PLAIN_DATE) & t.rlike(PLAIN_CLOCK))
