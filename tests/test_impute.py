import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators.impute import Category, Field, impute, with_group_mean, with_nested_means


def fields(**kw):
    return [Field("y", F.col("y"), 0.0, math.inf), Field("n", F.col("n"), 0.0, 10.0, whole=True), Field("z", F.col("z"), -100.0, 100.0, helper=True)]


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    truth, rows = {}, []
    for i in range(6000):
        x = rng.uniform(0, 10)
        z = 2 * x + rng.gauss(0, 0.1)
        y = 5 + 3 * x + rng.gauss(0, 0.5)
        n = min(10, max(0, round(y / 5 + rng.gauss(0, 0.1))))
        truth[i] = (y, n)
        lost = rng.random() < 0.2
        rows.append((i, x, None if rng.random() < 0.3 else z, rng.choice([None, -1.0, math.nan, math.inf]) if lost else y, rng.choice([None, 99, -3]) if rng.random() < 0.2 else n, "keep", True))
    return truth, spark.createDataFrame(rows, "id long, x double, z double, y double, n int, y_value string, y_filled boolean")


def test_held_out_values_masks_and_spread(made):
    truth, df = made
    out = impute(df, "id", fields(), {"x": F.col("x")}).collect()
    assert len(out) == len(truth) and out[0].__fields__.count("y_value") == 1 and "_pattern" not in out[0].__fields__
    bad = lambda v, top: v is None or not (math.isfinite(v) and 0 <= v <= top)
    errors, drawn = [], 0
    for r in out:
        assert r["y_filled"] == bad(r["y"], math.inf) and r["n_filled"] == bad(r["n"], 10)
        assert r["y_filled"] or r["y_value"] == r["y"]
        assert r["n_value"] == round(r["n_value"]) and 0 <= r["n_value"] <= 10
        if r["y_filled"]:
            errors.append(r["y_value"] - truth[r["id"]][0])
    spread = math.sqrt(sum(e * e for e in errors) / len(errors))
    # True spread 0.5; a value plus a draw of it is off by 0.7. The mean of the field would be off by 8.
    assert 0.55 < spread < 0.85 and abs(sum(errors) / len(errors)) < 0.1
    exact = [r["y_value"] - truth[r["id"]][0] for r in impute(df, "id", fields(), {"x": F.col("x")}, noise=0.0).collect() if r["y_filled"]]
    assert math.sqrt(sum(e * e for e in exact) / len(exact)) < 0.56


def test_same_draws_whatever_the_partitions(made):
    _, df = made
    a = {r["id"]: r["y_value"] for r in impute(df, "id", fields(), {"x": F.col("x")}).collect()}
    b = {r["id"]: r["y_value"] for r in impute(df.repartition(7), "id", fields(), {"x": F.col("x")}).collect()}
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_all_missing_empty_and_repeated(spark):
    schema = "id long, x double, z double, y double, n int"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, math.nan, 1.0, None, 3)]
    out = impute(spark.createDataFrame(rows, schema), "id", fields(), {"x": F.col("x")}).collect()
    assert len(out) == 3 and all(r["y_filled"] and r["y_value"] is not None and r["y_value"] >= 0 for r in out)
    assert impute(spark.createDataFrame([], schema), "id", fields(), {"x": F.col("x")}).count() == 0
    with pytest.raises(ValueError):
        impute(spark.createDataFrame([], schema), "id", [Field(f"f{i}", F.col("y"), 0, 1) for i in range(9)], {})


def test_group_mean(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, 5.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["m"] for r in with_group_mean(df, [F.col("g")], F.col("v"), "m").collect()}
    assert got == {("a", 1.0): 2.0, ("a", 3.0): 2.0, ("a", None): 2.0, ("b", None): None, (None, 5.0): None}


def test_nested_means(spark):
    rows = [("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, None), ("b", 1, 5.0), (None, 1, 7.0), ("a", None, 9.0), (None, None, None)]
    df = spark.createDataFrame([(*r, "old") for r in rows], "g string, h int, v double, gh string")
    keys = {"k": F.col("g"), "l": F.col("h")}
    out = with_nested_means(df, keys, F.col("v"), {"gh": [F.col("k"), F.col("l")], "gm": [F.col("k")], "hm": [F.col("l")]})
    assert out.columns == ["g", "h", "v", "gh", "gm", "hm"]
    got = {(r["g"], r["h"], r["v"]): (r["gh"], r["gm"], r["hm"]) for r in out.collect()}
    mean = 13 / 3
    assert got == {("a", 1, 1.0): (2.0, mean, 4.0), ("a", 1, 3.0): (2.0, mean, 4.0), ("a", 2, None): (None, mean, None), ("b", 1, 5.0): (5.0, 5.0, 4.0), (None, 1, 7.0): (None, None, 4.0), ("a", None, 9.0): (None, mean, None), (None, None, None): (None, None, None)}


def test_categories_by_held_out_cells(spark):
    rng = random.Random(9)
    truth, rows = {}, []
    for i in range(6000):
        x = rng.uniform(0, 10)
        c = "low" if x + rng.gauss(0, 0.3) < 3 else "mid" if x < 7 else "high"
        truth[i] = c
        rows.append((i, x, rng.choice([None, "?"]) if rng.random() < 0.25 else c, None if rng.random() < 0.2 else 2 * x + rng.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "id long, x double, c string, z double")
    fields = [Category("c", F.col("c"), ("low", "mid", "high")), Field("z", F.col("z"), -100.0, 100.0)]
    steps = {f"over{k}": F.greatest(F.lit(0.0), F.col("x") - k) for k in (2, 3, 4, 6, 7, 8)}
    for noise, least in ((0.0, 0.9), (1.0, 0.75)):
        out = impute(df, "id", fields, {"x": F.col("x"), **steps}, noise=noise).collect()
        filled = [r for r in out if r["c_filled"]]
        assert {r["id"] for r in filled} == {r[0] for r in rows if r[2] in (None, "?")} and all(r["c_value"] == r["c"] for r in out if not r["c_filled"])
        assert sum(r["c_value"] == truth[r["id"]] for r in filled) / len(filled) > least
    share = lambda v: sum(r["c_value"] == v for r in filled) / len(filled)
    assert all(abs(share(v) - sum(truth[r["id"]] == v for r in filled) / len(filled)) < 0.06 for v in ("low", "mid", "high"))
    none = spark.createDataFrame([(1, 1.0, None, None), (1, 1.0, None, None)], "id long, x double, c string, z double")
    assert {r["c_value"] for r in impute(none, "id", fields, {}, noise=0.0).collect()} == {"low"}
    assert impute(none.limit(0), "id", fields, {}).count() == 0
