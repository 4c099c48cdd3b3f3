"""A whole run: check, ingest, integrate, compare, and say what happened."""

from __future__ import annotations

import argparse
import json
import logging
import os
import platform as host
import sys
import tempfile
import time
from collections.abc import Mapping
from pathlib import Path
from typing import Any
from uuid import uuid4

import pyspark
from pyspark.sql import SparkSession

from weftline.operators.enrich import assert_same_keys, require_unique
from weftline.plans import ingest, integrate, layouts
from weftline.plans.spec import ROLES, Integration, Platform
from weftline.sources import readers
from weftline.sources.shared import materialised
from weftline.sources.store import Store

#: Settings of every session: one zone for all instants, plans mended as they run, no shift of old dates, no call sites
#: kept with every expression (they make the building of large plans twice as slow).
SESSION = {
    "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.parquet.datetimeRebaseModeInRead": "CORRECTED", "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
}


def logger(name: str) -> logging.Logger:
    """To the standard output, by one handler a name."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
        log.propagate = False
    return log


def session(settings: Mapping[str, Any]) -> SparkSession:
    builder = SparkSession.builder.appName(settings.get("app_name", "weftline")).config(map=SESSION)
    if "master" in settings:
        builder = builder.master(settings["master"])
    if "shuffle_partitions" in settings:
        builder = builder.config("spark.sql.shuffle.partitions", settings["shuffle_partitions"])
    for key, name in (("adaptive", "spark.sql.adaptive.enabled"), ("coalesce", "spark.sql.adaptive.coalescePartitions.enabled")):
        if key in settings:
            builder = builder.config(name, str(settings[key]).lower())
    return builder.getOrCreate()


def write_json(values: Mapping[str, Any], path: str | Path) -> None:
    """By way of another file, so that a reader sees the old or the new one whole."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, suffix=".tmp")
    with os.fdopen(handle, "w") as out:
        json.dump(values, out, indent=2, default=str)
    os.replace(name, path)


def integrate_tables(store: Store, how: Integration, key: str = "trip_id") -> dict[str, Any]:
    """Reads the four clean tables, checks that no trip is lost or doubled, and publishes the enriched trips."""
    began = time.time()
    trips, zones, weather, air = (store.read(f"silver/{how.roles[r]}") for r in ROLES)
    require_unique(zones, ["location_id"])
    with materialised(integrate.integrated(trips, integrate.context(zones, weather, air))) as df:
        n = assert_same_keys(trips, df, key)
        found = integrate.context_coverage(df).first().asDict()
        store.overwrite(df, "silver/integrated", how.partition_by)
    return {"pipeline_name": "integrated", "output_path": f"{store.root}/silver/integrated", "total_records": n, "duration_seconds": round(time.time() - began, 3), "partition_columns": list(how.partition_by), "trip_identity_preserved": True, "context_coverage": found}


def preflight(spark: SparkSession, platform: Platform) -> None:
    """Resolves every source, rule and output, the integrated table's and its partitions too, before anything is written."""
    empty = {name: ingest.preflight(spark, spec) for name, spec in platform.datasets.items()}
    if platform.integration:
        trips, *others = (empty[platform.integration.roles[r]] for r in ROLES)
        out = integrate.integrated(trips, integrate.context(*others))
        readers.require_columns(out, platform.integration.partition_by, "partitions of the integrated table")
        readers.require_columns(out, ["trip_id"], "the integrated table")


def benchmark(store: Store, platform: Platform, run_id: str, reports: str | None) -> dict[str, Any]:
    """Compares the layouts of the trips; the report is written beside the summaries."""
    roles = platform.integration.roles
    result = layouts.compare(platform.datasets[roles["trips"]], store.read(f"silver/{roles['zones']}"), platform.benchmark.root, run_id, platform.benchmark.iterations, platform.version)
    text = layouts.report(result)
    if reports:
        path = Path(reports) / f"layouts_{run_id}.md"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return result


def run(platform: Platform, spark: SparkSession | None = None, summaries: str | None = None, skip_benchmark: bool = False) -> dict[str, Any]:
    """All datasets under one run id, then their integration and the comparison of layouts where the platform has them. The
    summary is written whether or not the run succeeds; an error of the run itself is raised again, one of the summary only if
    the run had none."""
    log, began, run_id = logger("weftline"), time.time(), uuid4().hex
    summary: dict[str, Any] = {"run_id": run_id, "schema_version": platform.version, "status": "running", "runtime": {"python": sys.version.split()[0], "spark": pyspark.__version__, "platform": host.platform()}, "ingestion": {}}
    own = spark is None
    failed: Exception | None = None
    try:
        spark = spark or session(platform.session)
        store = Store(spark, platform.root)
        preflight(spark, platform)
        for name, spec in platform.datasets.items():
            outcome = ingest.ingest(store, spec, platform.version, run_id)
            summary["ingestion"][name] = {**vars(outcome.account), "duration_seconds": outcome.duration_seconds}
            log.info("%s: %s", name, outcome.account)
        if platform.integration:
            summary["integration"] = integrate_tables(store, platform.integration)
        if platform.benchmark and not skip_benchmark:
            summary["benchmark"] = benchmark(store, platform, run_id, summaries)
        summary["status"] = "success"
    except Exception as error:
        failed = error
        summary |= {"status": "failed", "error": f"{type(error).__name__}: {error}"[:2000]}
    summary["total_execution_seconds"] = round(time.time() - began, 3)
    try:
        if summaries:
            write_json(summary, Path(summaries) / f"run_{run_id}.json")
            write_json(summary, Path(summaries) / "latest.json")
    except OSError as error:
        failed = failed or error
    finally:
        if own and spark is not None:
            spark.stop()
    if failed:
        raise failed
    return summary


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Ingests and integrates the datasets of a configuration, and compares layouts.")
    parser.add_argument("--config", required=True)
    parser.add_argument("--summaries", default="summaries")
    parser.add_argument("--skip-benchmark", action="store_true", help="leave out the comparison of layouts")
    given = parser.parse_args(args)
    run(Platform.load(given.config), summaries=given.summaries, skip_benchmark=given.skip_benchmark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
