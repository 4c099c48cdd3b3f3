"""Questions to the audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def most_failing(audit: DataFrame) -> DataFrame:
    """Datasets by their rejected rows and failed runs, worst first."""
    n = F.sum(F.when(F.col("status") == "failed", 1).otherwise(0))
    return audit.groupBy("dataset_name").agg(F.sum("rejected_records").alias("rejected"), n.alias("failed_runs")).orderBy(F.desc("rejected"), F.desc("failed_runs"), "dataset_name")


def longest(audit: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("dataset_name").orderBy(F.desc("duration_seconds"), "run_id"))
    return audit.withColumn("_r", rank).filter("_r = 1").select("dataset_name", "run_id", "duration_seconds")


def rejected_per_run(audit: DataFrame) -> DataFrame:
    return audit.groupBy("run_id").agg(F.sum("initial_records").alias("processed"), F.sum("valid_records").alias("inserted"), F.sum("rejected_records").alias("rejected"), F.max("schema_version").alias("schema_version"))


def duration_trend(audit: DataFrame) -> DataFrame:
    before = F.lag("duration_seconds").over(Window.partitionBy("dataset_name").orderBy("completed_at", "run_id"))
    return audit.select("dataset_name", "run_id", "completed_at", "duration_seconds", (F.col("duration_seconds") - before).alias("change_seconds"))
