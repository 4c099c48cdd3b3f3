from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weftline.plans import features
from weftline.sources.store import Store
from weftline.streaming import incremental as inc


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "tables"))


def test_releases(spark, store):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "id int, v string")
    assert inc.apply_release(store, "t", first, ["id"], "r1").inserted == 2
    second = spark.createDataFrame([(2, "changed", 50.0), (3, "c", 60.0), (3, "c", 60.0)], "id int, v string, humidity double")
    done = inc.apply_release(store, "t", second, ["id"], "r2")
    assert (done.inserted, done.ignored, done.added_columns) == (1, 2, ["humidity"])
    want = [(1, "a", None), (2, "b", None), (3, "c", 60.0)]
    got = lambda: sorted(tuple(r) for r in store.read_appended("t").select("id", "v", "humidity").collect())
    assert got() == want
    inc.apply_release(store, "t", second, ["id"], "r2")
    assert got() == want
    with pytest.raises(ValueError, match="another type"):
        inc.apply_release(store, "t", spark.createDataFrame([("x", "y")], "id string, v string"), ["id"], "r3")


def test_only_batch_applied_again_under_a_number(spark, store):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        assert inc.apply_release(store, "t", df, ["id"], "001").inserted == 2
    assert inc.apply_release(store, "t", df, ["id"], "002").inserted == 0
    assert inc.apply_release(store, "t", df, ["id"], "001").inserted == 2 and store.read_appended("t").count() == 2


def test_stream_equals_batch(spark, store, tmp_path):
    source = spark.range(100).select((F.col("id") % 40).alias("id"), (F.col("id") % 40 * 2).alias("v"))
    source.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = inc.read_stream(spark, source, str(tmp_path / "in"), 2)
    inc.stream_into(store, stream, "s", ["id"], str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(tuple(r) for r in store.read_appended("s").select("id", "v").collect()) == [(i, 2 * i) for i in range(40)]


def test_windows_with_watermark(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=i), "x" if i % 2 else "y") for i in range(60)]
    spark.createDataFrame(rows, "at timestamp, k string").write.parquet(str(tmp_path / "in"))
    stream = inc.read_stream(spark, spark.createDataFrame(rows, "at timestamp, k string"), str(tmp_path / "in"))
    q = inc.windowed_counts(stream, "at", ["k"], "10 minutes", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windows").count() == 12 and {r["n"] for r in spark.table("windows").collect()} == {5}


def test_model(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(hours=i), float(i % 24) if i % 50 else None, "a" if i % 3 else "b", 2.0 * (i % 24) + (5.0 if i % 3 else 0.0)) for i in range(2000)]
    df = features.temporal_features(spark.createDataFrame(rows, "at timestamp, x double, c string, y double"), "at")
    train, validation, test = features.split_by_time(df, "at")
    assert train.count() + validation.count() + test.count() == 2000 and train.agg(F.max("at")).first()[0] < test.agg(F.min("at")).first()[0]
    numeric = ["x", "hour_cos", "hour_sin"]
    model = features.train(train, "y", numeric, ["c"], str(tmp_path / "m"))
    scores = features.evaluate(features.load(str(tmp_path / "m")), test, "y")
    assert scores["r2"] > 0.9 and scores == features.evaluate(model, test, "y")
