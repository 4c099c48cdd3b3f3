"""From a source to a clean table: read, prepare, classify, publish, account."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.temporal import with_instant
from weftline.operators import quality, standardize
from weftline.plans.spec import DatasetSpec
from weftline.sources import readers
from weftline.sources.shared import materialised
from weftline.sources.store import Store


def prepared(raw: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Standard names, safe casts, scope, defaults, instants, derived columns; lazy."""
    readers.require_columns(raw, spec.required, spec.name)
    df = standardize.safe_cast(standardize.renamed(raw, spec.rename), spec.casts)
    df = quality.in_scope(df, spec.sql(spec.scope) if spec.scope else None)
    df = standardize.with_defaults(df, spec.defaults)
    for name, sql in spec.instants.items():
        df = with_instant(df, F.expr(spec.sql(sql)), spec.timezone, f"_{name}", lenient=True)
        df = df.withColumn(f"_{name}_utc", F.timestamp_micros(f"_{name}_utc_us")).drop(f"_{name}_utc_us")
    for name, sql in spec.derived.items():  # each may use those before it
        df = df.withColumn(name, F.expr(spec.sql(sql)))
    return df


def rules(spec: DatasetSpec) -> dict[str, str]:
    return {n: spec.sql(r) for n, r in spec.rules.items()}


def classified(raw: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Judged rows; keys that occur twice are found at once (see quality.classified), the rest is lazy."""
    return quality.classified(prepared(readers.spread(raw), spec), rules(spec), spec.key, spec.tie_break)


def clean(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    return standardize.projected(quality.accepted(df), spec.selected)


def preflight(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """Resolves source, rules, output and partition columns without reading rows or writing anything; the clean table, empty."""
    checked = quality.with_errors(prepared(readers.load(spark, spec.format, spec.source_path), spec), rules(spec), spec.key)
    out = standardize.projected(checked, spec.selected)
    readers.require_columns(out, spec.partition_by, f"{spec.name} partitions")
    return spark.createDataFrame([], out.schema)


@dataclass(frozen=True)
class Outcome:
    dataset: str
    run_id: str
    account: quality.Account | None
    duration_seconds: float
    status: str
    error: str | None = None


def ingest(store: Store, spec: DatasetSpec, version: str, run_id: str | None = None, on_step: Callable[[str], None] = lambda s: None) -> Outcome:
    """Bronze, then rejects, then the clean table, then the audit row. A failure leaves an audit row with its message too.

    The source is read once, into bronze, and judged once, from there; judged rows lie in the shared folder meanwhile. Rejects
    are a batch of the run's id: the same run written again replaces its own.
    """
    run_id, began = run_id or uuid4().hex, time.time()
    try:
        raw = readers.load(store.spark, spec.format, spec.source_path)
        quality.with_errors(prepared(raw, spec), rules(spec), spec.key)  # what can't be resolved fails before anything is written
        bronze = f"bronze/{spec.name}"
        stored = store.read(bronze, store.overwrite(standardize.sanitised(raw).withColumn("_ingestion_timestamp", F.current_timestamp()), bronze))
        on_step("bronze")
        read = stored.drop("_ingestion_timestamp").toDF(*raw.columns)
        with materialised(classified(read, spec)) as judged:
            found = quality.account(judged, read.count())
            stamps = {"_run_id": F.lit(run_id), "_schema_version": F.lit(version), "_rejected_at": F.current_timestamp()}
            store.append(quality.rejected(judged).withColumns(stamps), f"quarantine/{spec.name}", run_id)
            on_step("quarantine")
            store.overwrite(clean(judged, spec), f"silver/{spec.name}", spec.partition_by)
            on_step("silver")
        done = Outcome(spec.name, run_id, found, time.time() - began, "success")
    except Exception as error:
        audit(store, spec, version, Outcome(spec.name, run_id, None, time.time() - began, "failed", str(error)[:500]))
        raise
    audit(store, spec, version, done)
    return done


def audit(store: Store, spec: DatasetSpec, version: str, outcome: Outcome) -> None:
    a = outcome.account
    counts = {k: getattr(a, k) if a else 0 for k in ("initial", "valid", "rejected", "duplicates", "invalid", "out_of_scope")}
    row = {
        "dataset_name": spec.name, "file_format": spec.format, "schema_version": version, "run_id": outcome.run_id,
        **{f"{k}_records": v for k, v in counts.items()},
        "bronze_path": f"{store.root}/bronze/{spec.name}", "silver_path": f"{store.root}/silver/{spec.name}", "quarantine_path": f"{store.root}/quarantine/{spec.name}",
        "source_timezone": spec.timezone, "partition_columns": json.dumps(list(spec.partition_by)), "duration_seconds": float(outcome.duration_seconds), "status": outcome.status, "error": outcome.error,
    }
    frame = readers.single_row(store.spark, row).withColumns({f"{k}_records": F.col(f"{k}_records").cast("bigint") for k in counts} | {"completed_at": F.current_timestamp()})
    store.append(frame.coalesce(1), "metadata/ingestions", f"{outcome.run_id}-{spec.name}")
