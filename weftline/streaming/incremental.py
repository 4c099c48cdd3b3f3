"""New releases of a table applied without building it anew."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import orphans
from weftline.operators.enrich import lookup
from weftline.operators.quality import first_by_key
from weftline.operators.standardize import schema_changes
from weftline.sources.shared import delete_folder, kept
from weftline.sources.store import Store


@dataclass(frozen=True)
class Applied:
    inserted: int
    ignored: int
    added_columns: list[str]


def apply_release(store: Store, table: str, release: DataFrame, key: Sequence[str], batch: str) -> Applied:
    """Appends the rows of a release whose key the table lacks; those it has stay as they are, repeats are ignored.

    New columns are added, being null in older rows; a column of another type is an error before anything is written. The
    same batch applied again replaces itself, so nothing is doubled. Null keys are ignored.
    """
    some = release.filter(" and ".join(f"`{k}` is not null" for k in key))
    order = [F.xxhash64(*(f"`{c}`" for c in sorted(release.columns)))]
    once = first_by_key(some, key, order)
    added: list[str] = []
    if store.batches(table, without=batch):
        known = store.read_appended(table, without=batch)
        changes = schema_changes(known.drop("batch"), release)
        if changes["retyped"]:
            raise ValueError(f"{table}: columns of another type: {changes['retyped']}")
        added = changes["added"]
        once = once.join(known.select(*key), list(key), "left_anti")
    store.append(once.select(*release.columns), table, batch)
    inserted = store.spark.read.parquet(f"{store.root}/{table}/batch={batch}").count()
    return Applied(inserted, release.count() - inserted, added)


def stream_into(store: Store, source: DataFrame, table: str, key: Sequence[str], checkpoint: str):
    """A stream applied release by release until nothing more is there; batches are named by number, so a repeated one is no harm."""

    def each(df: DataFrame, number: int) -> None:
        apply_release(store, table, df, key, f"stream{number:09d}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(source: DataFrame, at: str, by: Sequence[str], width: str, late: str) -> DataFrame:
    """Counts per window of time and group; rows later than ``late`` behind the newest are left out."""
    return source.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n"))


class OrphanTracker:
    """The state of orphan references, carried from period to period in tables of a store.

    What a call writes is named by the span of its periods. The last span applied again replaces itself, so nothing is counted
    twice; a span that overlaps others, or leaves a gap, is refused. States of spans but the last two are deleted.
    """

    def __init__(self, store: Store, name: str = "orphans"):
        self.store, self.name = store, name

    @staticmethod
    def _span(cuts: Sequence[str | None]) -> str:
        digits = lambda t, none: none if t is None else "".join(c for c in t if c.isdigit())
        return f"{digits(cuts[0], '0' * 14)}-{digits(cuts[-1], '9' * 14)}"

    def _read(self, table: str, span: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.store.root}/{self.name}/{table}/batch={span}")

    def spans(self) -> list[str]:
        """Those that are done: each has written its moves and state before its mark."""
        return sorted(self.store.batches(f"{self.name}/spans"))

    def advance(self, refs: DataFrame, index: DataFrame, *cuts: str | None) -> DataFrame:
        """Applies the periods between the cuts one after the other, and gives their new orphans. The references are scanned
        once; the next span reads none of them again."""
        span, done = self._span(cuts), self.spans()
        if any(a >= b for a, b in zip(self._points(cuts), self._points(cuts)[1:])) or len(cuts) < 2:
            raise ValueError("cuts must ascend")
        if span in done and span != done[-1]:
            raise ValueError(f"{span}: only the last span can be applied again")
        earlier = [s for s in done if s != span]
        if earlier and earlier[-1].split("-")[1] != span.split("-")[0]:
            raise ValueError(f"{span}: must begin where {earlier[-1]} ends")
        state = self._read("state", earlier[-1]) if earlier else None
        index = lookup(index)
        self.store.append(orphans.arrivals(refs, index, cuts), f"{self.name}/arrivals", span)
        arrived, moves = self._read("arrivals", span), []
        counts = kept(orphans.counted(arrived))
        for i, (since, until) in enumerate(zip(cuts, cuts[1:])):
            settled = kept(orphans.settle(state, counts.filter(F.col("period") == i), index, since, until))
            state = orphans.state_of(settled)
            moves.append(orphans.moves_of(settled))
        self.store.append(reduce(DataFrame.unionAll, moves), f"{self.name}/moves", span)
        self.store.append(state, f"{self.name}/state", span)
        self.store.append(self.store.spark.range(1), f"{self.name}/spans", span)
        for old in earlier[:-1]:
            delete_folder(self.store.spark, f"{self.store.root}/{self.name}/state/batch={old}")
        return orphans.opened(arrived)

    @staticmethod
    def _points(cuts: Sequence[str | None]) -> list[str]:
        return [c if c is not None else "" if i == 0 else "~" for i, c in enumerate(cuts)]

    def opened(self) -> DataFrame:
        """All orphans as they were found at their arrival."""
        return orphans.opened(self._all("arrivals"))

    def state(self) -> DataFrame:
        """Per field and key, what has arrived and what waits after the last span."""
        return self._read("state", self.spans()[-1])

    def snapshots(self) -> DataFrame:
        return orphans.snapshots(self._all("moves").groupBy("month", "field_name", "move").agg(F.sum("n").alias("n")))

    def _all(self, table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (self._read(table, s) for s in self.spans()))


def read_stream(spark: SparkSession, like: DataFrame, path: str, files: int = 10) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)
