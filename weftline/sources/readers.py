"""Readers by format, checks of what was read, and small helpers around views and files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: All columns of a CSV are texts, so that malformed values survive to be reported; a broken line ends the read.
CSV = {"header": "true", "inferSchema": "false", "mode": "FAILFAST"}

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": lambda s, p: s.read.options(**CSV).csv(p),
    "parquet": lambda s, p: s.read.parquet(p),
    "json": lambda s, p: s.read.json(p),
    "orc": lambda s, p: s.read.orc(p),
}


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Path may hold wildcards; it is handed on as it is."""
    if kind not in READERS:
        raise ValueError(f"unsupported format: {kind}")
    return READERS[kind](spark, path)


def require_columns(df: DataFrame, names: Sequence[str], what: str) -> DataFrame:
    """Names are compared with their case."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing required columns: {missing}")
    return df


def single_row(spark: SparkSession, values: Mapping[str, Any]) -> DataFrame:
    """None becomes a null text."""
    return spark.range(1).select(*((F.lit(None).cast("string") if v is None else F.lit(v)).alias(k) for k, v in values.items()))


@contextmanager
def view(df: DataFrame, prefix: str = "v") -> Iterator[str]:
    """A view of its own name for the time of a block."""
    name = f"{prefix}_{uuid4().hex}"
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


#: A table of fewer bytes may be a single row group, hence a single task.
SMALL_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's own estimate, for files that of the columns read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt out over all cores, for work that costs more than the reading; a large one, of many tasks, as it is.
    Rows are the same either way."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if estimated_bytes(df) < SMALL_BYTES else df


def inventory(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes and numbers of files below a path, of any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = {"bytes": 0, "data_bytes": 0, "files": 0, "data_files": 0}
    files = at.getFileSystem(conf).listFiles(at, True)
    while files.hasNext():
        f = files.next()
        data = f.getPath().getName().endswith(".parquet")
        for key, n in (("bytes", f.getLen()), ("files", 1)):
            found[key] += n
            if data:
                found[f"data_{key}"] += n
    return found
