import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import columns as C
from weftline.operators import quality, standardize


def trips(spark, rows):
    return spark.createDataFrame(rows, "id string, pickup string, fare double, tip double")


RULES = {"valid_pickup": "pickup <> 'bad'", "valid_fare": "fare BETWEEN 0 AND 20"}


def judge(df, **kw):
    return quality.classified(df, RULES, ["id"], **kw)


def test_reasons_and_account(spark):
    df = trips(spark, [("a", "x", 10.0, 0.0), ("a", "x", 10.0, 0.0), ("b", "x", None, 0.0), ("c", "bad", 1.0, 0.0), ("d", "x", 25.0, 0.0), (None, "bad", None, 0.0)])
    out = judge(df)
    got = sorted((r["id"] or "", r["_rejection_reason"] or "") for r in out.collect())
    assert got == [("", "valid_pickup;valid_fare;missing_key:id"), ("a", ""), ("a", "duplicate_key"), ("b", "valid_fare"), ("c", "valid_pickup"), ("d", "valid_fare")]
    a = quality.account(out, 8)
    assert (a.valid, a.rejected, a.duplicates, a.invalid, a.out_of_scope) == (1, 5, 1, 4, 2)
    with pytest.raises(ValueError):
        quality.account(out, 5)
    assert {r["reason"]: r["n_rows"] for r in quality.reason_counts(out).collect()} == {"valid_pickup": 2, "valid_fare": 3, "missing_key:id": 1, "duplicate_key": 1}
    with pytest.raises(ValueError):
        quality.classified(df, RULES, [])


@pytest.mark.parametrize("tie", [None, ("tip",)])
def test_survivor_does_not_depend_on_order_or_invalid_rows(spark, tie):
    rows = [("k", "x", 5.0, 1.0), ("k", "x", 5.0, 9.0), ("k", "bad", 5.0, 0.0), ("j", "x", 1.0, 10.0), ("j", "x", 1.0, 9.0)]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        out = quality.accepted(judge(trips(spark, rows).repartition(3), tie_break=tie)).select("id", "tip").orderBy("id").collect()
        seen.add(tuple(map(tuple, out)))
    # By JSON text 10.0 comes before 9.0.
    assert seen == {(("j", 10.0 if tie is None else 9.0), ("k", 1.0))}


def test_judging_accepted_rows_again_rejects_nothing(spark):
    rng = random.Random(1)
    df = trips(spark, [(rng.choice("abcdef"), rng.choice(["x", "bad"]), rng.uniform(-5, 30), 0.0) for _ in range(300)])
    once = standardize.projected(quality.accepted(judge(df)), None)
    assert once.columns == df.columns and quality.rejected(judge(once)).count() == 0
    t = quality.totals(judge(df)).first()
    assert t["scoped"] == 300 == t["valid"] + t["rejected"]


def test_empty(spark):
    t = quality.totals(judge(trips(spark, []))).first()
    assert tuple(t) == (0, 0, 0, 0)


def test_scope_keeps_what_cannot_be_told(spark):
    df = spark.createDataFrame([(36, 5), (36, 7), (1, 5), (None, 5), (36, None)], "state int, county int")
    assert quality.in_scope(df, "state = 36 AND county IN (5, 47)").count() == 3
    assert quality.in_scope(df, None).count() == 5


def test_cast_errors_come_before_defaults(spark):
    df = spark.createDataFrame([("bad", "1"), (None, "2"), ("3", "x")], "passengers string, n string")
    cast = standardize.with_defaults(standardize.safe_cast(df, {"passengers": "int", "n": "bigint"}), {"passengers": 1})
    assert [tuple(r) for r in cast.collect()] == [(1, 1, ["invalid_type:passengers"]), (1, 2, []), (3, None, ["invalid_type:n"])]
    out = quality.classified(cast, {"p": "passengers > 0"}, ["n"])
    assert quality.rejected(out).count() == 2
    with pytest.raises(ValueError, match="missing cast columns"):
        standardize.safe_cast(df, {"gone": "int"})


def test_names_and_projection(spark):
    df = spark.createDataFrame([(1, 2)], "`a b(c);` int, PULocationID int")
    assert standardize.sanitised(df).columns == ["a_bc", "PULocationID"]
    assert standardize.renamed(df, {"PULocationID": "place"}).columns == ["a_b_c", "place"]
    with pytest.raises(Exception):
        standardize.projected(df, ["gone"]).collect()
    assert standardize.schema_changes(df.select(F.lit(1).alias("a"), F.lit("x").alias("b")), df.select(F.lit("1").alias("a"), F.lit(1).alias("c"))) == {"added": ["c"], "removed": ["b"], "retyped": ["a"]}


def test_missing_references(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert [r[0] for r in quality.missing_references(df, "k", spark.createDataFrame([(1,), (1,), (None,)], "p int"), "p").collect()] == [2]


def test_local_time(spark):
    df = spark.createDataFrame([("2024-01-01 23:30:00",), ("2024-03-10 01:55:00",), ("2024-03-10 02:30:00",), ("2024-03-10 03:05:00",), ("bad",)], "t string")
    at, zone = C.parsed_timestamp(F.col("t")), "America/New_York"
    got = df.select(C.utc_of(at, zone).cast("string"), C.local_exists(at, zone)).collect()
    assert [tuple(r) for r in got] == [("2024-01-02 04:30:00", True), ("2024-03-10 06:55:00", True), ("2024-03-10 07:30:00", False), ("2024-03-10 07:05:00", True), (None, False)]
    span = spark.sql("SELECT timestamp'2024-03-10 06:55:00' AS a, timestamp'2024-03-10 07:05:00.9' AS b")
    assert span.select(C.minutes_between(F.col("a"), F.col("b"))).first()[0] == 10.0


def test_keys(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "x", None)], "a int, b string, c string")
    ids = [r[0] for r in df.select(C.hash_key([F.col(c) for c in "abc"])).collect()]
    assert ids[0] != ids[1] and all(len(i) == 64 for i in ids)
    key = spark.sql("SELECT 2024 AS y, 3 AS m, 4 AS d, 5 AS h").select(C.calendar_key(*(F.col(c) for c in "ymdh"))).first()[0]
    assert key == "2024_03_04_05"
    assert [r[0] for r in df.select(C.mapped(F.col("b"), {"x": 1})).collect()] == [None, 1]


@pytest.mark.parametrize(("most", "small"), [(1 << 20, 0), (10, 0), (0, 1 << 70)])
def test_one_key_and_identical_rows_hold_most(spark, most, small):
    """By a broadcast of the keys that occur twice, by a shuffle where they are too large for that, and by a window over a small table."""
    rows = [("hot", "x", 5.0, 1.0)] * 900 + [("hot", "bad", 5.0, 0.0)] * 50 + [(f"k{i % 20}", "x", 5.0, float(i)) for i in range(100)]
    df = trips(spark, rows).repartition(11)
    kept = quality.accepted(quality.classified(df, RULES, ["id"], ("tip",), most, small)).select("id", "tip").collect()
    assert sorted(map(tuple, kept)) == sorted([("hot", 1.0), *((f"k{i}", float(i)) for i in range(20))])
    t = quality.totals(quality.classified(df, RULES, ["id"], ("tip",), most, small)).first()
    assert tuple(t) == (1050, 21, 1029, 979)


def test_rows_stay_where_they_are(spark, tmp_path):
    """Only keys travel: without ties no row of the table is shuffled or sorted."""
    trips(spark, [(f"k{i % 50}", "x", 5.0, float(i)) for i in range(100)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = quality.classified(df, RULES, ["id"], ("tip",), small=0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "BroadcastExchange" in plan and "Sort" not in plan and "Window" not in plan
    assert sorted(r["tip"] for r in quality.accepted(out).collect()) == [float(i) for i in range(50)]
    whole = quality.classified(df, RULES, ["id"], ("tip",))
    assert "Window" in whole._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, whole.collect())) == sorted(map(str, out.select(whole.columns).collect()))


def test_order_of_nulls_and_several_columns(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", None, "y"), ("a", None, "x"), ("b", 1, None), ("b", 1, "a")], "id string, n int, s string")
    kept = lambda t: sorted(map(tuple, quality.accepted(quality.classified(df, {}, ["id"], t)).select("id", "n", "s").collect()), key=str)
    assert kept(("n", "s")) == [("a", None, "x"), ("b", 1, None)]
    assert [(k, n) for k, n, _ in kept(("n",))] == [("a", None), ("b", 1)]
