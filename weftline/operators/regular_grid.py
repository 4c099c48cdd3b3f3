"""Irregular readings brought onto an hourly grid per source, holes filled by seasonal regression (problem 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = 168
#: Harmonics of the day and of the week, each with a cosine and a sine.
PERIODS = ((24, 2), (168, 1))
#: The trend is measured in years of 8766 hours from this hour (2020-01-01 00:00 UTC), which keeps the sums well scaled.
TREND_ORIGIN, TREND_UNIT = 438_288, 8_766.0
#: A source with fewer hours than these is fitted by fewer terms: all, trend with one daily harmonic, the mean alone.
FULL_FIT_HOURS, SMALL_FIT_HOURS = 72, 24
#: Hours that one step of filling a gap makes.
GAP_STEP = 1_000


def hour_index(at: Column) -> Column:
    """Whole hours since 1970 of a timestamp without zone (or of one with zone, in a session whose zone is UTC)."""
    return (F.date_diff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(at)).cast("bigint")


def usable_hours(df: DataFrame, source: str, at: str, value: str, low: float, high: float) -> DataFrame:
    """Mean and number of usable readings per source and hour.

    This first step bounds every source at one row an hour, whatever share of the readings it holds; readings are
    summed before the shuffle.
    """
    v = F.col(value).cast("double")
    return (
        df.filter(F.col(source).isNotNull() & F.col(at).isNotNull() & v.between(low, high) & ~F.isnan(v))
        .groupBy(F.col(source).alias("source"), hour_index(F.col(at)).alias("hour"))
        .agg(F.avg(v).alias("value"), F.count(F.lit(1)).alias("n_readings"))
    )


def _terms(hour: np.ndarray) -> np.ndarray:
    waves = [f(2 * np.pi * k * hour / period) for period, n in PERIODS for k in range(1, n + 1) for f in (np.cos, np.sin)]
    return np.stack(waves, axis=-1)


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Normal equations of each source from its sums per hour of the week (at most 168 of them) and their solution."""
    for pdf in batches:
        sources, fits = [], []
        for source, parts in zip(pdf["source"], pdf["parts"]):
            s = {k: np.array([p[k] for p in parts], dtype=float) for k in ("slot", "n", "t", "tt", "y", "ty")}
            waves = np.column_stack([np.ones(len(parts)), _terms(s["slot"])])
            size = 2 + waves.shape[1] - 1
            gram, right = np.zeros((size, size)), np.zeros(size)
            at = [0, *range(2, size)]  # the trend is term 1
            gram[np.ix_(at, at)] = waves.T @ (waves * s["n"][:, None])
            gram[1, at] = gram[at, 1] = waves.T @ s["t"]
            gram[1, 1] = s["tt"].sum()
            right[at], right[1] = waves.T @ s["y"], s["ty"].sum()
            hours = gram[0, 0]
            used = list(range(size)) if hours >= FULL_FIT_HOURS else [0, 1, 2, 3] if hours >= SMALL_FIT_HOURS else [0]
            fit = np.zeros(size)
            g = gram[np.ix_(used, used)]
            scale = np.sqrt(np.maximum(np.diag(g), 1e-12))
            fit[used] = np.linalg.lstsq(g / np.outer(scale, scale) + 1e-9 * np.eye(len(used)), right[used] / scale, rcond=1e-12)[0] / scale
            sources.append(source)
            fits.append(fit.tolist())
        yield pd.DataFrame({"source": pd.Series(sources, dtype=pdf["source"].dtype), "fit": fits})


def seasonal_fits(hours: DataFrame) -> DataFrame:
    """Coefficients per source: mean, trend, daily and weekly harmonics.

    The seasonal terms depend on the hour of the week alone, so the normal equations need five sums for each of its 168
    hours; these are summed before the shuffle, and a source's equations are put together from at most 168 rows.
    """
    t = (F.col("hour") - TREND_ORIGIN) / TREND_UNIT
    y = F.col("value")
    sums = hours.groupBy("source", F.pmod(F.col("hour"), F.lit(WEEK)).alias("slot")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(t).alias("t"), F.sum(t * t).alias("tt"), F.sum(y).alias("y"), F.sum(t * y).alias("ty")
    )
    grouped = sums.groupBy("source").agg(F.collect_list(F.struct("slot", "n", "t", "tt", "y", "ty")).alias("parts"))
    kind = dict(hours.dtypes)["source"]
    return grouped.mapInPandas(_solve, f"source {kind}, fit array<double>")


def predicted(fit: Column, hour: Column) -> Column:
    value = fit[0] + fit[1] * ((hour - TREND_ORIGIN) / TREND_UNIT)
    at = 2
    for period, n in PERIODS:
        for k in range(1, n + 1):
            angle = F.pmod(hour, F.lit(period)) * (2 * np.pi * k / period)
            value = value + fit[at] * F.cos(angle) + fit[at + 1] * F.sin(angle)
            at += 2
    return value


def regular_grid(df: DataFrame, source: str, at: str, value: str, low: float, high: float) -> DataFrame:
    """One row per source and UTC hour from its first to its last usable reading.

    Columns: source, hour (since 1970), value, n_readings, status. ``observed``: the mean of the hour's usable readings;
    ``filled``: the regression's value plus the residual carried in a straight line between the observed hours on both
    sides, kept within low and high; ``marked``: an empty hour whose value couldn't be computed (null). Readings with a
    null source, time or value, NaN, or a value outside low..high are not usable; repeated readings weigh in the mean
    and never add rows; a source with none has no rows; extra columns are left out.
    """
    hours = usable_hours(df, source, at, value, low, high)
    fitted = hours.join(seasonal_fits(hours), "source", "left")
    fitted = fitted.withColumn("residual", F.col("value") - predicted(F.col("fit"), F.col("hour")))
    order = Window.partitionBy("source").orderBy("hour")
    spans = fitted.select("*", F.lead("hour").over(order).alias("next_hour"), F.lead("residual").over(order).alias("next_residual"))
    last = F.coalesce(F.col("next_hour") - 1, F.col("hour"))
    # In two steps, so that a gap of centuries makes no array of all its hours.
    parts = spans.select("*", last.alias("last"), F.explode(F.sequence("hour", last, F.lit(GAP_STEP).cast("bigint"))).alias("part"))
    grid = parts.select("*", F.explode(F.sequence("part", F.least(F.col("part") + (GAP_STEP - 1), F.col("last")))).alias("grid_hour"))
    seen = F.col("grid_hour") == F.col("hour")
    share = (F.col("grid_hour") - F.col("hour")) / (F.col("next_hour") - F.col("hour"))
    bridged = predicted(F.col("fit"), F.col("grid_hour")) + F.col("residual") + (F.col("next_residual") - F.col("residual")) * share
    kept = F.when(~F.isnan(bridged), F.greatest(F.lit(low), F.least(F.lit(high), bridged)))
    out = grid.select("source", F.col("grid_hour").alias("hour"), F.when(seen, F.col("value")).otherwise(kept).alias("value"), F.when(seen, F.col("n_readings")).otherwise(0).alias("n_readings"), seen.alias("seen"))
    return out.select("source", "hour", "value", "n_readings", F.when(F.col("seen"), "observed").when(F.col("value").isNotNull(), "filled").otherwise("marked").alias("status"))
