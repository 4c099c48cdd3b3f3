import math
import random
from collections import defaultdict

import pytest

from weftline.operators.dense_keys import per_key, regroup


def brute(rows):
    out = defaultdict(lambda: [0, 0, 0.0])
    for k, v in rows:
        out[k][0] += 1
        if v is not None and math.isfinite(v):
            out[k][1] += 1
            out[k][2] += v
    return {k: (a, b, round(c, 6) if b else None) for k, (a, b, c) in out.items()}


def got(df):
    return {r["key"]: (r["rows"], r["n_v"], None if r["sum_v"] is None else round(r["sum_v"], 6)) for r in df.collect()}


@pytest.mark.parametrize("most", [1_000_000, 10])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_equals_brute_force_with_a_hot_key(spark, most, kind):
    """By one dictionary for all, and by a dictionary of each batch where there are too many keys for that."""
    rng = random.Random(2)
    rows = []
    for _ in range(20_000):
        k = 5 if rng.random() < 0.5 else rng.choice([None, *range(6000)])
        rows.append((None if k is None else k if kind == "int" else f"k{k}", rng.choice([None, math.nan, math.inf, 1.25, -3.5, 2.0])))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"k {kind}, v double, key int, rows int").repartition(5)
    assert got(per_key(df, "k", ["v"], most)) == brute(rows)


def test_empty_only_null_and_no_measure(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert per_key(empty, "k", ["v"]).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, 1.0)], "k int, v double")
    assert got(per_key(nulls, "k", ["v"])) == {None: (2, 1, 1.0)}
    assert [tuple(r) for r in per_key(nulls, "k").collect()] == [(None, 2)]


def test_regroup(spark):
    totals = per_key(spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 3.0), (9, 4.0)], "k int, v double"), "k", ["v"])
    groups = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "key int, group string")
    assert got(regroup(totals, groups)) == {"x": (3, 3, 6.0), None: (1, 1, 4.0)}
