import math
from datetime import datetime, timedelta

from weftline.operators.regular_grid import regular_grid

T0 = datetime(2024, 1, 1)


def grid(spark, rows, schema="s int, at timestamp_ntz, v double"):
    out = regular_grid(spark.createDataFrame(rows, schema), "s", "at", "v", 0.0, 1000.0).collect()
    return {(r["source"], r["hour"]): (r["value"], r["n_readings"], r["status"]) for r in out}


def h(k):
    return int((T0 - datetime(1970, 1, 1)).total_seconds() // 3600) + k


def test_one_row_an_hour_and_only_usable_readings(spark):
    at = lambda k, m=0: T0 + timedelta(hours=k, minutes=m)
    rows = [(1, at(0), 10.0), (1, at(0, 59), 20.0), (1, at(3), 30.0), (1, at(1), None), (1, at(2), -1.0), (1, at(9), math.nan), (1, None, 5.0), (None, at(5), 5.0), (2, at(4), 7.0), (2, at(4), 7.0)]
    got = grid(spark, rows)
    assert sorted(got) == [(1, h(0)), (1, h(1)), (1, h(2)), (1, h(3)), (2, h(4))]
    assert got[1, h(0)] == (15.0, 2, "observed") and got[2, h(4)] == (7.0, 2, "observed")
    assert [got[1, h(k)][2] for k in (1, 2)] == ["filled", "filled"]
    # Too few hours for more than a mean: the bridge between 15 and 30 remains.
    assert [round(got[1, h(k)][0], 6) for k in (1, 2)] == [20.0, 25.0]


def test_held_out_hours_of_a_seasonal_series(spark):
    truth = lambda k: 50 + 0.01 * k + 20 * math.cos(2 * math.pi * k / 24) + 5 * math.sin(2 * math.pi * k / 168)
    missing = set(range(200, 218)) | {30, 31, 400}
    rows = [(7, T0 + timedelta(hours=k, minutes=k % 60), truth(k)) for k in range(600) if k not in missing]
    got = grid(spark, rows)
    assert len(got) == 600
    assert {k for k in range(600) if got[7, h(k)][2] == "filled"} == missing
    assert max(abs(got[7, h(k)][0] - truth(k)) for k in missing) < 0.5  # a straight line alone would be off by 40


def test_empty_hot_source_and_bounds(spark):
    assert grid(spark, []) == {}
    rows = [(1, T0 + timedelta(hours=k % 5 * 2, seconds=k), 1.0) for k in range(3000)] + [(2, T0, 1.0), (2, T0 + timedelta(hours=3), 1000.0)]
    got = grid(spark, rows)
    assert len(got) == 9 + 4 and sum(v[1] for k, v in got.items() if k[0] == 1) == 3000
    assert all(0 <= v[0] <= 1000 for v in got.values())


def test_before_1970_and_extra_columns(spark):
    rows = [(1, datetime(1969, 12, 31, 22, 30), 1.0, "x", 9), (1, datetime(1970, 1, 1, 1, 10), 1.0, "y", 9)]
    got = grid(spark, rows, "s int, at timestamp_ntz, v double, source string, hour int")
    assert sorted(k[1] for k in got) == [-2, -1, 0, 1]


def test_gap_of_centuries(spark):
    rows = [(1, datetime(1900, 1, 1), 1.0), (1, datetime(2100, 1, 1), 2.0)]
    out = regular_grid(spark.createDataFrame(rows, "s int, at timestamp_ntz, v double"), "s", "at", "v", 0.0, 1000.0)
    assert out.count() == (datetime(2100, 1, 1) - datetime(1900, 1, 1)).days * 24 + 1
