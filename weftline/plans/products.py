"""Analyses of integrated trips, and the summaries that are kept of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.store import Store


def _n() -> Column:
    return F.count(F.lit(1))


def monthly_demand(trips: DataFrame, zone: str, at: str) -> DataFrame:
    return trips.groupBy(F.col(zone).alias("zone"), F.date_format(at, "yyyy-MM").alias("month")).agg(_n().alias("trip_count"))


def weather_condition(precipitation: str, temperature: str) -> Column:
    """A name for the weather of a row; ``unknown`` without a measure."""
    p, t = F.col(precipitation), F.col(temperature)
    return F.when(p > 0, F.when(t <= 0, "snow").otherwise("rain")).when(t < 0, "freezing").when(p.isNull() & t.isNull(), "unknown").otherwise("dry")


def mean_by_condition(trips: DataFrame, condition: Column, value: str, name: str, digits: int = 4) -> DataFrame:
    return trips.groupBy(condition.alias("condition")).agg(F.round(F.avg(value), digits).alias(name), _n().alias("trip_count"))


def demand_by_level(trips: DataFrame, level: str, at: str, width: float = 2.5) -> DataFrame:
    """Trips and hours per band of an hourly level, and so trips per hour."""
    band = F.floor(F.col(level) / width).cast("int")
    hours = trips.groupBy(band.alias("band"), F.col(at).alias("hour")).agg(_n().alias("trip_count"))
    return hours.groupBy("band").agg(F.sum("trip_count").alias("trip_count"), _n().alias("n_hours"), F.round(F.avg("trip_count"), 4).alias("trips_per_hour"))


def level_correlation(trips: DataFrame, level: str, at: str) -> DataFrame:
    """One row: the number of hours, and how the trips of an hour go with its level (Pearson; null without spread)."""
    hours = trips.groupBy(F.col(at).alias("hour")).agg(_n().cast("double").alias("n"), F.avg(level).alias("level"))
    return hours.agg(_n().alias("n_hours"), F.round(F.corr("n", "level"), 6).alias("correlation"))


def demand_variation(trips: DataFrame, zone: str, condition: Column, at: str, top: int) -> DataFrame:
    """Zones by how much their trips per hour differ between conditions; the first ``top`` of them, a report."""
    hours = trips.groupBy(F.col(zone).alias("zone"), condition.alias("condition"), F.col(at).alias("hour")).agg(_n().alias("n"))
    rates = hours.groupBy("zone", "condition").agg((F.sum("n") / _n()).alias("rate"))
    spread = rates.groupBy("zone").agg(F.round(F.max("rate") - F.min("rate"), 6).alias("spread"), _n().alias("n_conditions"))
    order = [F.desc("spread"), F.asc_nulls_last("zone")]
    return spread.orderBy(*order).limit(top).withColumn("position", F.row_number().over(Window.orderBy(*order)))  # of the report's rows alone


def peak_hours(trips: DataFrame, at: str) -> DataFrame:
    """The busiest hour of each weekday (1 is Sunday), the earlier of equal ones."""
    counts = trips.groupBy(F.dayofweek(at).alias("weekday"), F.hour(at).alias("hour")).agg(_n().alias("trip_count"))
    rank = F.row_number().over(Window.partitionBy("weekday").orderBy(F.desc("trip_count"), "hour"))
    return counts.withColumn("_r", rank).filter("_r = 1").drop("_r")


def monthly_trend(trips: DataFrame, at: str) -> DataFrame:
    counts = trips.groupBy(F.date_format(at, "yyyy-MM").alias("month")).agg(_n().alias("trip_count"))
    before = F.lag("trip_count").over(Window.orderBy("month"))  # one row a month
    return counts.withColumns({"change": F.col("trip_count") - before, "change_pct": F.round((F.col("trip_count") - before) * 100.0 / before, 4)})


def daily_summary(trips: DataFrame, at: str, amounts: Sequence[str]) -> DataFrame:
    return trips.groupBy(F.to_date(at).alias("day")).agg(_n().alias("trip_count"), *(F.round(F.avg(a), 4).alias(f"avg_{a}") for a in amounts))


def label_summary(trips: DataFrame, label: str, amounts: Sequence[str]) -> DataFrame:
    return trips.groupBy(F.col(label).alias("label")).agg(_n().alias("trip_count"), *(F.round(F.avg(a), 4).alias(f"avg_{a}") for a in amounts))


Product = Callable[[Mapping[str, DataFrame]], DataFrame]


class Products:
    """Kept summaries with their sources: only those whose sources changed are made anew."""

    def __init__(self, store: Store, version: str):
        self.store, self.version = store, version
        self.made: dict[str, tuple[tuple[str, ...], Product]] = {}

    def define(self, name: str, sources: Sequence[str], make: Product) -> None:
        self.made[name] = (tuple(sources), make)

    def affected(self, changed: Sequence[str]) -> list[str]:
        return [n for n, (sources, _) in self.made.items() if set(sources) & set(changed)]

    def refresh(self, changed: Sequence[str] | None = None) -> list[str]:
        """Makes the affected products (all without ``changed``), each with its source, creation, refresh and schema version."""
        names = list(self.made) if changed is None else self.affected(changed)
        for name in names:
            sources, make = self.made[name]
            df = make({s: self.store.read(s) for s in sources})
            created = self.store.read(f"products/{name}").agg(F.min("_created_at")).first()[0] if self.store.exists(f"products/{name}") else None
            now = F.current_timestamp()
            stamps = {"_source": F.lit(",".join(sources)), "_created_at": F.lit(created) if created else now, "_refreshed_at": now, "_schema_version": F.lit(self.version), "_refresh_id": F.lit(uuid4().hex)}
            self.store.overwrite(df.withColumns(stamps), f"products/{name}")
        return names
