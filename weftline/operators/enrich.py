"""Facts enriched by lookups, two-stage means and labelled fallbacks, none lost or multiplied."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.shared import kept

#: A lookup of at most so many bytes is broadcast.
BROADCAST_BYTES = 32 << 20
FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows, and bytes as they lie in memory: fixed columns by eight, others by the length of their text."""
    long = [F.octet_length(F.col(f"`{c}`") if t in ("string", "binary") else F.to_json(F.struct(F.col(f"`{c}`")))) for c, t in df.dtypes if t not in FIXED]
    size = F.lit(16 + 8 * len(df.columns))
    for c in long:
        size = size + F.coalesce(c, F.lit(0))
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    return n, total


def lookup(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Computed once, written to the shared folder and measured: broadcast up to ``most`` bytes. A larger one is joined by a
    shuffle, whose hot keys Spark splits at run time."""
    there = kept(df)
    return F.broadcast(there) if measured(there)[1] <= most else there


def require_unique(lookup: DataFrame, key: Sequence[str]) -> DataFrame:
    """Raises if a key is null or occurs twice; else the lookup."""
    bad = lookup.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.greatest(*(F.col(k).isNull().cast("int") for k in key), F.lit(0)).cast("boolean"))
    if not bad.isEmpty():
        raise ValueError(f"lookup keys must be unique and not null: {list(key)}")
    return lookup


def looked_up(facts: DataFrame, lookup: DataFrame, on: Mapping[str, str], values: Mapping[str, str], matched: str | None = None) -> DataFrame:
    """Left join on ``fact column: lookup column``, adding ``new name: lookup column``; ``matched`` flags facts that found one.

    Facts keep their rows as long as the lookup's key is unique. Names of the lookup can't clash with those of the facts.
    """
    slim = lookup.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(on.values())), *(F.col(c).alias(f"_v{i}") for i, c in enumerate(values.values())), F.lit(True).alias("_hit"))
    condition = [facts[f] == slim[f"_k{i}"] for i, f in enumerate(on)]
    joined = facts.join(slim, condition, "left")
    added = [F.col(f"_v{i}").alias(n) for i, n in enumerate(values)]
    flag = [F.coalesce(F.col("_hit"), F.lit(False)).alias(matched)] if matched else []
    return joined.select(*(facts[c] for c in facts.columns), *added, *flag)


def labelled(df: DataFrame, columns: Sequence[str], label: str = "Unknown") -> DataFrame:
    return df.fillna({c: label for c in columns})


def group_mean(df: DataFrame, by: Sequence[str], value: str, name: str, digits: int | None = None) -> DataFrame:
    mean = F.avg(value)
    return df.groupBy(*by).agg((mean if digits is None else F.round(mean, digits)).alias(name))


def unit_means(readings: DataFrame, unit: Sequence[str], by: Sequence[str], value: str) -> DataFrame:
    """First stage: the mean of each unit (a site, say) per group, over its instruments. Missing unit columns are an error."""
    missing = [c for c in (*unit, *by) if c not in readings.columns]
    if missing:
        raise ValueError(f"complete site identifiers are needed, missing: {missing}")
    return group_mean(readings, [*by, *unit], value, "unit_mean")


def level_means(units: DataFrame, by: Sequence[str], name: str, digits: int = 2) -> DataFrame:
    """Second stage: every unit weighs the same, however many readings it has."""
    return group_mean(units, by, "unit_mean", name, digits)


def with_fallback(df: DataFrame, sources: Mapping[str, str], name: str) -> DataFrame:
    """``name``: the first that isn't null of the columns (``label: column``, in order); ``<name>_source``: its label or ``missing``."""
    label: Column = F.lit("missing")
    for k, c in reversed(list(sources.items())):
        label = F.when(F.col(c).isNotNull(), k).otherwise(label)
    return df.withColumns({name: F.coalesce(*sources.values()), f"{name}_source": label})


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: n_rows, and n_keys, the exact number of distinct keys that aren't null."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))


def key_differences(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """side, key: rows of ``before`` whose key ``after`` lacks (``lost``), and the other way round (``new``)."""
    one = lambda a, b, side: a.select(key).join(b.select(key), key, "left_anti").select(F.lit(side).alias("side"), F.col(key).alias("key"))
    return one(before, after, "lost").unionAll(one(after, before, "new"))


def assert_same_keys(before: DataFrame, after: DataFrame, key: str) -> int:
    """Raises unless both have the same keys, none null or twice; else their number."""
    for df in (before, after):
        n, distinct = key_counts(df, key).first()
        if n != distinct:
            raise ValueError(f"{key}: null or repeated")
    if not key_differences(before, after, key).isEmpty():
        raise ValueError(f"{key}: lost or replaced")
    return n


def coverage(df: DataFrame, labels: Sequence[str], flags: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows per value of each label column, and rows of each flag, in one pass."""
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(name)
    return df.agg(*(n(F.col(c) == v, f"{c}_{v}_rows") for c in labels for v in names), *(n(F.col(f), f"{f}_rows") for f in flags))
