"""Names, types and defaults."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.spec import standard_names


def renamed(df: DataFrame, rename: Mapping[str, str] | None = None) -> DataFrame:
    """All columns by their standard names."""
    return df.toDF(*standard_names(df.columns, rename or {}))


def sanitised(df: DataFrame) -> DataFrame:
    """Blanks become underscores; brackets and semicolons go."""
    return df.toDF(*(c.translate(str.maketrans(" ", "_", "();")) for c in df.columns))


def labels(found: Mapping[str, Column]) -> Column:
    """Array of the labels whose condition holds, in order. Without a lambda, as lambdas and all in them run interpreted."""
    return F.array_remove(F.array(*(F.when(c, n).otherwise("") for n, c in found.items())), "") if found else F.array().cast("array<string>")


def safe_cast(df: DataFrame, casts: Mapping[str, str], errors: str = "_cast_errors") -> DataFrame:
    """Casts what can be cast, in one projection; ``errors`` lists ``invalid_type:<column>`` for each value that can't.

    Null values are no error.
    """
    missing = sorted(set(casts) - set(df.columns))
    if missing:
        raise ValueError(f"missing cast columns: {missing}")
    tried = {c: F.col(f"`{c}`").try_cast(t) for c, t in casts.items()}
    found = labels({f"invalid_type:{c}": F.col(f"`{c}`").isNotNull() & v.isNull() for c, v in tried.items()})
    return df.select(*(tried[c].alias(c) if c in tried else F.col(f"`{c}`") for c in df.columns), found.alias(errors))


def with_defaults(df: DataFrame, defaults: Mapping[str, Any]) -> DataFrame:
    """Nulls replaced; cast errors found before stay errors."""
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c, v in defaults.items()}) if defaults else df


def projected(df: DataFrame, selected: Sequence[str] | None) -> DataFrame:
    """Without bookkeeping columns (those that begin with an underscore), of the selected ones; an absent one is an error."""
    return df.select(*(f"`{c}`" for c in selected)) if selected else df.select(*(f"`{c}`" for c in df.columns if not c.startswith("_")))


def schema_changes(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    """Columns added, removed and of another type."""
    a, b = dict(before.dtypes), dict(after.dtypes)
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "retyped": sorted(c for c in a.keys() & b.keys() if a[c] != b[c])}
