"""Tables as snapshots of Parquet files: whole overwrites and appends that readers never see half done.

``<root>/<table>/v=<n>`` is a snapshot; the largest n whose write has ended (Spark's _SUCCESS file) is the current one. A
failed write changes nothing, a reader keeps the files it began with, and earlier versions stay until they are pruned.
``<root>/<table>/batch=<id>`` are the batches of a table that only grows; a batch written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, table: str, part: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/{part}".rstrip("/"))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _parts(self, table: str, prefix: str) -> list[str]:
        """Ended writes by name."""
        fs, path = self._folder(table)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return [n for n in names if n.startswith(prefix) and fs.exists(self._folder(table, f"{n}/_SUCCESS")[1])]

    def versions(self, table: str) -> list[int]:
        return sorted(int(n[2:]) for n in self._parts(table, "v="))

    def overwrite(self, df: DataFrame, table: str, partition_by: Sequence[str] = ()) -> int:
        """Writes a new snapshot, of any schema. Partitions are gathered first, so each gets few files; skewed ones are split."""
        fs, path = self._folder(table)
        taken = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")] if fs.exists(path) else []
        n = max(taken, default=0) + 1
        if partition_by:
            df = df.hint("rebalance", *partition_by)
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{self.root}/{table}/v={n}")
        return n

    def read(self, table: str, version: int | None = None) -> DataFrame:
        versions = self.versions(table)
        if not versions or (version is not None and version not in versions):
            raise ValueError(f"no such snapshot: {table} {version or ''}".rstrip())
        return self.spark.read.parquet(f"{self.root}/{table}/v={version or versions[-1]}")

    def prune(self, table: str, keep: int = 1) -> None:
        for n in self.versions(table)[:-keep]:
            fs, path = self._folder(table, f"v={n}")
            fs.delete(path, True)

    def append(self, df: DataFrame, table: str, batch: str) -> None:
        """Columns may be added, but a column keeps its type: that is compared before anything is written."""
        if self._parts(table, "batch="):
            known = dict(self.read_appended(table).drop("batch").dtypes)
            clash = {c: (known[c], t) for c, t in df.dtypes if known.get(c, t) != t}
            if clash:
                raise ValueError(f"{table}: columns of another type: {clash}")
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")

    def batches(self, table: str, without: str | None = None) -> list[str]:
        return [p[6:] for p in self._parts(table, "batch=") if p != f"batch={without}"]

    def read_appended(self, table: str, without: str | None = None) -> DataFrame:
        """All batches, or all but one; ``batch`` is their id, of the type that Spark takes it for."""
        parts = [f"batch={b}" for b in self.batches(table, without)]
        if not parts:
            raise ValueError(f"no such table: {table}")
        base = f"{self.root}/{table}"
        return self.spark.read.option("mergeSchema", "true").option("basePath", base).parquet(*(f"{base}/{p}" for p in parts))

    def exists(self, table: str) -> bool:
        return bool(self._parts(table, "v=") or self._parts(table, "batch="))
