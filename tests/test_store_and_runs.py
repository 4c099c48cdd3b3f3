import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from city import specs as city
from weftline.plans import ingest, layouts, monitoring, run
from weftline.plans.products import Products
from weftline.plans.spec import ROLES, Benchmark, DatasetSpec, Integration, Platform
from weftline.sources import readers
from weftline.sources.store import Store


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "tables"))


def test_snapshots(spark, store):
    store.overwrite(spark.range(3), "t")
    before = store.read("t")
    store.overwrite(store.read("t").withColumn("x", F.lit("new")), "t")  # from itself, with another schema
    assert before.count() == 3 and store.read("t").columns == ["id", "x"] and store.read("t", 1).columns == ["id"]
    with pytest.raises(Exception):
        store.overwrite(spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")), "t")
    assert store.versions("t") == [1, 2] and store.read("t").count() == 3
    assert store.overwrite(spark.range(5).withColumn("p", F.col("id") % 2), "t", ["p"]) == 4
    store.prune("t")
    assert store.versions("t") == [4] and store.read("t").filter("p = 1").count() == 2
    with pytest.raises(ValueError):
        store.read("gone")


def test_appends(spark, store):
    store.append(spark.range(2), "a", "one")
    store.append(spark.range(1).withColumn("x", F.lit(1)), "a", "two")
    store.append(spark.range(3), "a", "one")  # again: replaces itself
    got = store.read_appended("a")
    assert got.count() == 4 and got.filter("x is null").count() == 3
    with pytest.raises(ValueError, match="another type"):
        store.append(spark.range(1).withColumn("x", F.lit("text")), "a", "three")
    assert store.read_appended("a").count() == 4


def csv_spec(tmp_path, text, name="zones"):
    path = tmp_path / f"{name}.csv"
    path.write_text(text)
    return DatasetSpec(name=name, format="csv", source_path=str(path), required=("LocationID", "Borough", "Zone", "service_zone"), key=("location_id", "zone"), rename={"LocationID": "location_id"}, casts={"location_id": "bigint"}, rules={"zone_b": "service_zone = 'B'"}, selected=("location_id", "borough", "zone", "service_zone"))


def test_csv_twice(spark, store, tmp_path):
    spec = csv_spec(tmp_path, "Zone,LocationID,Borough,service_zone\nE,1,Bronx,B\nC,1,Bronx,B\nE,1,Bronx,B\nD,2,Bronx,X\nE,bad,Bronx,B\nE,3,Bronx,\n")
    ingest.preflight(spark, spec)
    runs = [ingest.ingest(store, spec, "1.0") for _ in range(2)]
    a = runs[0].account
    assert (a.initial, a.valid, a.rejected, a.duplicates, a.out_of_scope) == (6, 2, 4, 1, 0)
    assert dict(store.read("silver/zones").dtypes)["location_id"] == "bigint" and store.read("bronze/zones").count() == 6
    rejects = store.read_appended("quarantine/zones")
    assert rejects.count() == 8 and rejects.select("_run_id").distinct().count() == 2
    audit = store.read_appended("metadata/ingestions")
    assert audit.count() == 2 and audit.first()["invalid_records"] == 3
    assert monitoring.most_failing(audit).first()["rejected"] == 8
    assert monitoring.longest(audit).count() == 1 and monitoring.rejected_per_run(audit).count() == 2
    assert [r["change_seconds"] is None for r in monitoring.duration_trend(audit).orderBy("completed_at").collect()] == [True, False]


def test_failures(spark, store, tmp_path):
    with pytest.raises(ValueError, match="missing required columns"):
        ingest.ingest(store, csv_spec(tmp_path, "LocationID\n1\n", "short"), "1.0", "r1")
    row = store.read_appended("metadata/ingestions").first()
    assert (row["status"], row["dataset_name"]) == ("failed", "short") and not store.exists("silver/short")
    with pytest.raises(Exception):
        ingest.ingest(store, csv_spec(tmp_path, "LocationID,Borough,Zone,service_zone\n1,a\n", "ragged"), "1.0")
    with pytest.raises(ValueError, match="unsupported format"):
        readers.load(spark, "xlsx", "/x")


def platform_of(small, root, **change):
    specs = {n: f(f"{small}/{n}.parquet") for n, f in city.ALL.items()} | change
    return Platform("2.0", f"{root}/t", specs, integration=Integration(ROLES, ("pickup_year",)), benchmark=Benchmark(f"{root}/layouts", 1))


def test_whole_run(spark, small, tmp_path):
    platform = platform_of(small, tmp_path)
    summary = run.run(platform, spark, str(tmp_path / "s"))
    saved = json.loads((tmp_path / "s" / "latest.json").read_text())
    assert summary["status"] == saved["status"] == "success" and saved["run_id"] == summary["run_id"]
    store = Store(spark, platform.root)
    n = store.read("silver/taxi_trips").count()
    assert store.read("silver/integrated").count() == n == summary["integration"]["total_records"] > 0
    assert store.read_appended("metadata/ingestions").select("run_id").distinct().count() == 1
    found, trips = summary["benchmark"], summary["ingestion"]["taxi_trips"]
    for s in found["storage"].values():
        assert (s["source_records"], s["rejected_records"], s["out_of_scope_records"], s["rows"]) == (trips["initial"], trips["rejected"], 0, n)
    text = (tmp_path / "s" / f"layouts_{summary['run_id']}.md").read_text()
    assert text == layouts.report(found) and "schema version 2.0" in text and "raw rows" in text and "| one_month |" in text


def test_preflight_stops_a_run_before_it_writes(spark, small, tmp_path):
    from dataclasses import replace

    gone = platform_of(small, tmp_path / "a", weather=city.weather("/nowhere.parquet"))
    unknown = replace(platform_of(small, tmp_path / "b"), integration=Integration(ROLES, ("no_such_column",)))
    for platform in (gone, unknown):
        with pytest.raises(Exception):
            run.run(platform, spark, str(tmp_path / "s"))
        assert json.loads((tmp_path / "s" / "latest.json").read_text())["status"] == "failed" and not Store(spark, platform.root).exists("bronze/taxi_zones")


def test_command(monkeypatch):
    seen = {}
    monkeypatch.setattr(run.Platform, "load", lambda path: path)
    monkeypatch.setattr(run, "run", lambda platform, **kw: seen.update(kw, platform=platform))
    for args, skipped in (([], False), (["--skip-benchmark"], True)):
        assert run.main(["--config", "p.yaml", *args]) == 0
        assert seen == {"platform": "p.yaml", "summaries": "summaries", "skip_benchmark": skipped}


def rows_read(spark):
    """Rows that all stages so far have read from files, by stage."""
    jvm = spark._jvm
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {s.stageId(): s.inputRecords() for s in jvm.scala.jdk.CollectionConverters.SeqHasAsJava(stages).asJava()}


def test_layouts(spark, small, tmp_path):
    zone = city.zones(f"{small}/taxi_zones.parquet")
    zones = ingest.clean(ingest.classified(spark.read.parquet(zone.source_path), zone), zone)
    result = layouts.compare(city.trips(f"{small}/taxi_trips.parquet"), zones, str(tmp_path), "r", 2, "1")
    assert result["equivalent"] and len({s["rows"] for s in result["storage"].values()}) == 1
    assert "Join" in result["queries"]["one_day"]["plain"]["physical_plan"]
    assert "PartitionFilters: [isnotnull(pickup_date" in result["queries"]["one_day"]["daily"]["physical_plan"]
    assert "PartitionFilters: [isnotnull(pickup_year" in result["queries"]["one_month"]["monthly"]["physical_plan"]
    assert "PushedFilters: [IsNotNull(pickup_date)" in result["queries"]["one_day"]["plain"]["physical_plan"]
    for bad in ({"status": "failed"}, {"equivalent": False}, {"queries": {}}, {"input_kind": "clean"}):
        with pytest.raises(ValueError):
            layouts.report({**result, **bad})


def test_every_sample_reads_its_input(spark, small, tmp_path, monkeypatch):
    """Each sample of each query reads the rows again: a frame that has run would keep its finished stages."""
    reads, inner = [], layouts.latency

    def counted(action, iterations, before=lambda: None):
        def once():
            old = rows_read(spark)
            out = action()
            deadline = 100
            while deadline and not (new := sum(n for k, n in rows_read(spark).items() if k not in old)):
                deadline -= 1
                time.sleep(0.05)
            reads.append(new)
            return out

        return inner(once, iterations, before)

    monkeypatch.setattr(layouts, "latency", counted)
    monkeypatch.setattr(layouts, "QUERIES", {"trips_per_borough": layouts.QUERIES["trips_per_borough"]})
    zone = city.zones(f"{small}/taxi_zones.parquet")
    zones = ingest.clean(ingest.classified(spark.read.parquet(zone.source_path), zone), zone)
    result = layouts.compare(city.trips(f"{small}/taxi_trips.parquet"), zones, str(tmp_path), "r", 2)
    assert len(reads) == 9 and all(n >= result["rows"] for n in reads)


def test_equal_rows_and_latency():
    assert layouts.equal_rows([("a", 1.0), ("b", None)], [("b", None), ("a", 1.0 + 1e-12)])
    assert not layouts.equal_rows([("a", 1.0)], [("a", 1.1)]) and not layouts.equal_rows([("a", 1.0)], []) and not layouts.equal_rows([("a",), ("a",)], [("a",), ("b",)])
    got = layouts.latency(lambda: None, 1)
    assert got["stdev_ms"] == 0.0 and len(got["samples_ms"]) == 1


def test_products_refresh_only_what_changed(spark, store):
    store.overwrite(spark.range(4), "silver/x")
    store.overwrite(spark.range(2), "silver/y")
    p = Products(store, "1.0")
    p.define("nx", ["silver/x"], lambda t: t["silver/x"].agg(F.count("*").alias("n")))
    p.define("ny", ["silver/y"], lambda t: t["silver/y"].agg(F.count("*").alias("n")))
    assert p.refresh() == ["nx", "ny"]
    created = store.read("products/nx").first()["_created_at"]
    store.overwrite(spark.range(9), "silver/x")
    assert p.refresh(["silver/x"]) == ["nx"]
    row = store.read("products/nx").first()
    assert (row["n"], row["_source"], row["_schema_version"], row["_created_at"]) == (9, "silver/x", "1.0", created) and row["_refreshed_at"] > created
    assert store.versions("products/ny") == [1]


def test_views_and_inventory(spark, tmp_path):
    with readers.view(spark.range(3)) as name:
        assert spark.sql(f"SELECT count(*) FROM {name}").first()[0] == 3
    assert not spark.catalog.tableExists(name)
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    found = readers.inventory(spark, str(tmp_path / "p"))
    assert found["data_files"] == 1 < found["files"] and 0 < found["data_bytes"] == found["bytes"]  # the mark of success is empty
    assert tuple(readers.single_row(spark, {"a": 1, "b": None, "c": datetime(2024, 1, 1)}).first()) == (1, None, datetime(2024, 1, 1))


def test_experiment(spark, small):
    trips, zones = spark.read.parquet(f"{small}/taxi_trips.parquet"), spark.read.parquet(f"{small}/taxi_zones.parquet").select("location_id", "borough").distinct()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    make = lambda: trips.join(zones, trips.pickup_location_id == zones.location_id, "left").groupBy("borough").count()
    found = layouts.experiment(spark, make, iterations=1, cached=[zones])
    assert set(found) == {*layouts.VARIANTS, "cached"} and all(f["same_rows"] for f in found.values())
    assert "AdaptiveSparkPlan" not in found["not adaptive"]["physical_plan"] and "InMemoryTableScan" in found["cached"]["physical_plan"]
    assert "BroadcastHashJoin" in found["as set"]["physical_plan"] and "BroadcastHashJoin" not in found["no broadcast"]["physical_plan"]
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive
