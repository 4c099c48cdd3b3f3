"""The folder that all executors share, and what is kept there for a while."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import TypeVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


T = TypeVar("T")


def ensure_shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a local one is set only where none is, as in tests on one machine.

    Checkpoints are deleted once nothing refers to them. Spark reads that setting at each checkpoint, so it is set here for
    sessions that run already.
    """
    context = spark.sparkContext
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    there = context.getCheckpointDir()
    if there:
        return there
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftline-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Computed once and written to the shared folder, so that neither a lost executor nor a second use computes it again."""
    ensure_shared_folder(df.sparkSession)
    return df.checkpoint()


def together(*makes: Callable[[], T]) -> list[T]:
    """Results of functions that each start jobs of their own, run side by side: small jobs leave most of a cluster idle."""
    with ThreadPoolExecutor(len(makes)) as pool:
        return [f.result() for f in [pool.submit(m) for m in makes]]


def delete_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shared_folder(spark: SparkSession, prefix: str) -> Iterator[str]:
    """A folder of its own below the shared one for the time of a block."""
    path = f"{ensure_shared_folder(spark)}/{prefix}-{uuid4().hex}"
    try:
        yield path
    finally:
        delete_folder(spark, path)


@contextmanager
def materialised(df: DataFrame) -> Iterator[DataFrame]:
    """Written to the shared folder as Parquet for the time of a block: later steps read only the columns they need."""
    with shared_folder(df.sparkSession, "kept") as path:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
