"""Every registered query with SQL gives the rows of that SQL on the smallest tables."""

import os

import duckdb
import pytest

from city import catalogue
from city.grid_orphans import FIELDS
from weftline.operators import orphans

CORE = catalogue.queries()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    return c


def text(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, small, duck, name):
    df, other = CORE[name](spark, small), duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    at = [other.columns.index(c) for c in columns]
    assert sorted([text(r[c]) for c in columns] for r in df.collect()) == sorted([text(r[i]) for i in at] for r in other.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE) - set(catalogue.oracle_sql())))
def test_runs(spark, small, name):
    assert CORE[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["table_name", "row_id", "utc_us", "status"]


def test_scans_read_only_what_they_need(spark, small):
    trips, zones = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("taxi_trips", "taxi_zones"))
    refs, index = orphans.references(trips, "row_id", FIELDS, "ingestion_timestamp"), orphans.parent_index(zones, "location_id", "listed_at", "delisted_at")
    plan = orphans.arrivals(refs, index, [None, "2024-02-01 00:00:00", None])._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if "taxi_trips" in x]
    assert len(scans) == 1 and "row_id" in scans[0] and "fare_amount" not in scans[0] and "SortMergeJoin" not in plan
