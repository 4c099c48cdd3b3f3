"""Missing values filled from similar records by chained equations (problem 4).

Each incomplete field is regressed on all others, round after round, the missing cells being replaced by the last round's
predictions. Rows that lack the same fields form a pattern, and within a pattern every imputed cell is a linear function
of what the row has. So the sums of products per pattern, taken in one pass over all rows, hold all that the rounds need:
they run on matrices of a fixed size, however many rows there are, and a second pass writes the values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.enrich import lookup

#: With more incomplete fields the patterns, at most two to their number, would be too many.
MAX_FIELDS = 8


@dataclass(frozen=True)
class Field:
    """An incomplete field: usable where its value is finite and within low..high. Helpers are imputed for the chain alone."""

    name: str
    value: Column
    low: float
    high: float
    whole: bool = False
    helper: bool = False

    def usable(self) -> Column:
        v = self.value.cast("double")
        return F.when(v.isNotNull() & ~F.isnan(v) & (v >= self.low) & (v <= self.high) & (F.abs(v) < float("inf")), v)


@dataclass(frozen=True)
class Category:
    """An incomplete field of a few values, as texts in ``values``; any other value, null too, counts as missing.

    Within the chain it is one indicator per value, regressed like the rest; a missing cell gets a value by the predicted
    shares of its values.
    """

    name: str
    value: Column
    values: tuple[str, ...]
    helper: bool = False

    def indicators(self) -> list[Column]:
        v = self.value.cast("string")
        return [F.when(v.isin(*self.values), F.when(v == x, 1.0).otherwise(0.0)) for x in self.values]


@dataclass(frozen=True)
class Model:
    """Per pattern of missing fields: weights of the constant, predictors and fields for each missing field, and its spread."""

    patterns: dict[int, tuple[np.ndarray, np.ndarray]]
    rounds: int


def _sums(df: DataFrame, names: list[str], pattern: str) -> dict[int, np.ndarray]:
    size = len(names) + 1
    x = [F.lit(1.0), *(F.col(n) for n in names)]
    pairs = [(i, k) for i in range(size) for k in range(i, size)]
    rows = df.groupBy(pattern).agg(*(F.sum(x[i] * x[k]).alias(f"s{i}_{k}") for i, k in pairs)).collect()  # at most 2 ** MAX_FIELDS rows
    found = {}
    for row in rows:
        gram = np.zeros((size, size))
        for i, k in pairs:
            gram[i, k] = gram[k, i] = row[f"s{i}_{k}"] or 0.0
        found[row[pattern]] = gram
    return found


def fit(grams: dict[int, np.ndarray], bits: Sequence[int], rounds: int) -> Model:
    """Runs the rounds on the sums of products; the fields are the last len(bits) variables, missing ones being 0 in the sums.

    bits: of each field the bit of the patterns that tells it is missing. Fields of one bit, the indicators of a category, are
    not regressed on each other.
    """
    if not grams:
        return Model({}, 0)
    size = next(iter(grams.values())).shape[0]
    fields = range(size - len(bits), size)
    bit = lambda j: bits[j - fields[0]] if j in fields else -1
    lacks = lambda p, j: bool(p >> bit(j) & 1)
    # L completes a row (identity on what it has), C is the spread of what it lacks.
    complete = {p: np.diag([0.0 if j in fields and lacks(p, j) else 1.0 for j in range(size)]) for p in grams}
    spread = {p: np.zeros((size, size)) for p in grams}
    for j in fields:
        have = [g for p, g in grams.items() if not lacks(p, j)]
        n = sum(g[0, 0] for g in have)
        mean = sum(g[0, j] for g in have) / n if n else 0.0
        for p in grams:
            if lacks(p, j):
                complete[p][j, 0] = mean
                spread[p][j, j] = max(0.0, sum(g[j, j] for g in have) / n - mean**2) if n else 0.0
    for _ in range(rounds):
        for j in fields:
            others = [k for k in range(size) if bit(k) != bit(j)]
            full = np.zeros((size, size))
            for p, g in grams.items():
                if not lacks(p, j):
                    full += complete[p] @ g @ complete[p].T + g[0, 0] * spread[p]
            if full[0, 0] == 0:
                continue
            gram, right = full[np.ix_(others, others)], full[others, j]
            scale = np.sqrt(np.maximum(np.diag(gram), 1e-12))
            weights = np.linalg.lstsq(gram / np.outer(scale, scale) + 1e-8 * np.eye(len(others)), right / scale, rcond=1e-12)[0] / scale
            rest = max(0.0, (full[j, j] - 2 * weights @ right + weights @ gram @ weights) / full[0, 0])
            for p in grams:
                if lacks(p, j):
                    complete[p][j] = weights @ complete[p][others]
                    c = spread[p]
                    row = weights @ c[np.ix_(others, others)]
                    c[j, others] = c[others, j] = row
                    c[j, j] = row @ weights + rest
    return Model({p: (complete[p], np.sqrt(np.maximum(np.diag(spread[p]), 0.0))) for p in grams}, rounds)


def _unit(key: Column, salt: str) -> Column:
    """A draw between 0 and 1 that depends on the key alone."""
    return (F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(2**52)) + 0.5) / 2**52


def _normal(key: Column, salt: str) -> Column:
    """A standard normal draw that depends on the key alone, so that a repeated task draws the same."""
    return F.sqrt(-2 * F.log(_unit(key, salt + "a"))) * F.cos(_unit(key, salt + "b") * (2 * np.pi))


def impute(df: DataFrame, key: str, fields: Sequence[Field | Category], predictors: dict[str, Column], rounds: int = 10, noise: float = 1.0) -> DataFrame:
    """Adds ``<field>_value`` and ``<field>_filled`` for each field that is no helper; all rows and columns stay.

    A usable cell keeps its value, ``filled`` being false. Any other (null, NaN, infinite, out of range) gets the value
    that the other fields and the predictors give, plus ``noise`` times a draw of the residual spread, kept in range, and
    rounded where the field is whole. Predictors that are null, NaN or infinite count as 0. A field that no row has is
    filled with 0, or the end of its range next to it. A category's cell gets one of its values, drawn by their predicted
    shares, or with ``noise`` 0 the likeliest; where no row has any, the first. An empty table gives an empty one. Columns that already have one of the
    added names are replaced; ``_z<n>``, ``_v<n>`` and ``_pattern`` are left out.
    """
    if len(fields) > MAX_FIELDS:
        raise ValueError(f"at most {MAX_FIELDS} incomplete fields")
    # A field has one variable, a category one per value; the variables of one have the same bit.
    variables = [(i, c) for i, f in enumerate(fields) for c in (f.indicators() if isinstance(f, Category) else [f.usable()])]
    bits = [i for i, _ in variables]
    zs, vs = [f"_z{i}" for i in range(len(predictors))], [f"_v{i}" for i in range(len(variables))]
    made = {*zs, *vs, "_pattern"} | {f"{f.name}_{end}" for f in fields if not f.helper for end in ("value", "filled")}
    used = [c for c in df.columns if c not in made]
    finite = lambda c: F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c).otherwise(0.0)
    ready = df.select(
        *(F.col(f"`{c}`") for c in used),
        *(finite(c.cast("double")).alias(z) for z, c in zip(zs, predictors.values())),
        *(c.alias(v) for v, (_, c) in zip(vs, variables)),
    )
    lead = [bits.index(i) for i in range(len(fields))]
    pattern = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(vs[k]).isNull(), 1 << i).otherwise(0) for i, k in enumerate(lead)))
    ready = ready.withColumn("_pattern", pattern)
    zero = ready.select("_pattern", *zs, *(F.coalesce(F.col(v), F.lit(0.0)).alias(v) for v in vs))
    model = fit(_sums(zero, zs + vs, "_pattern"), bits, rounds)
    x = [F.lit(1.0), *(F.col(z) for z in zs), *(F.coalesce(F.col(v), F.lit(0.0)) for v in vs)]

    def guess(field: int, k: int, draw: Column | None) -> Column:
        """What the model gives for variable k of a field in the rows that lack it, plus a draw of its spread."""
        j, out = 1 + len(zs) + k, F.lit(None).cast("double")
        for p, (complete, spread) in model.patterns.items():
            if p >> field & 1:
                value = reduce(lambda a, b: a + b, [x[n] * float(complete[j, n]) for n in range(len(x)) if complete[j, n]], F.lit(0.0))
                out = F.when(F.col("_pattern") == p, value if draw is None else value + draw * float(noise * spread[j])).otherwise(out)
        return out

    added = []
    for i, field in enumerate(fields):
        if field.helper:
            continue
        own = F.col(vs[lead[i]])
        if isinstance(field, Category):
            shares = [F.greatest(F.lit(1e-9), guess(i, lead[i] + n, None)) for n in range(len(field.values))]
            table = F.array(*(F.struct(s.alias("share"), F.lit(v).alias("value")) for s, v in zip(shares, field.values)))
            if noise:
                ends = F.transform(table, lambda e, n: F.struct(F.aggregate(F.slice(table, 1, n + 1), F.lit(0.0), lambda a, e: a + e["share"]).alias("end"), e["value"].alias("value")))
                place = _unit(F.col(key), field.name) * F.aggregate(table, F.lit(0.0), lambda a, e: a + e["share"])
                drawn = F.coalesce(F.get(F.filter(ends, lambda e: e["end"] > place), 0)["value"], F.lit(field.values[-1]))
            else:
                best = F.array_max(F.transform(table, lambda e: e["share"]))
                drawn = F.get(F.filter(table, lambda e: e["share"] == best), 0)["value"]
            added += [F.when(own.isNull(), drawn).otherwise(field.value.cast("string")).alias(f"{field.name}_value"), own.isNull().alias(f"{field.name}_filled")]
            continue
        value = F.greatest(F.lit(field.low), F.least(F.lit(field.high), guess(i, lead[i], _normal(F.col(key), field.name))))
        added += [F.coalesce(own, F.round(value) if field.whole else value).alias(f"{field.name}_value"), own.isNull().alias(f"{field.name}_filled")]
    return ready.select("*", *added).drop(*zs, *vs, "_pattern")


def with_group_mean(df: DataFrame, group: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Adds the mean of a value over the rows of a like group, null where no row of it has one; null keys form no group. A
    column that already has the name is replaced.

    The means are summed before their shuffle and joined as a lookup of measured size (see enrich.lookup).
    """
    keys = [f"_g{i}" for i in range(len(group))]
    keyed = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in (*keys, name)), *(g.alias(k) for g, k in zip(group, keys)))
    means = keyed.filter(value.isNotNull()).groupBy(*keys).agg(F.avg(value).alias(name))
    return keyed.join(lookup(means), keys, "left").drop(*keys)


def with_nested_means(df: DataFrame, keys: Mapping[str, Column], value: Column, levels: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Adds several means over like groups by one join: each level's group is made of the named keys.

    Sums per combination of the keys come first; the levels are summed from these, and rows are joined once on all keys,
    null ones included, by a lookup as in with_group_mean. A level with a null key gets null; columns that already have one of the names are replaced.
    """
    own = [f"_g{i}" for i in range(len(keys))]
    base = df.groupBy(*(k.alias(n) for n, k in keys.items())).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    for name, group in levels.items():
        over = Window.partitionBy(*group)
        known = reduce(lambda a, b: a & b, (g.isNotNull() for g in group))
        base = base.withColumn(name, F.when(known, F.sum("_sum").over(over) / F.nullif(F.sum("_n").over(over), F.lit(0))))
    means = base.select(*(F.col(n).alias(o) for n, o in zip(keys, own)), *levels)
    slim = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in (*levels, *own)), *(k.alias(f"_k{i}") for i, k in enumerate(keys.values())))
    same = reduce(lambda a, b: a & b, (F.col(f"_k{i}").eqNullSafe(F.col(o)) for i, o in enumerate(own)))
    return slim.join(lookup(means), same, "left").drop(*own, *(f"_k{i}" for i in range(len(keys))))
