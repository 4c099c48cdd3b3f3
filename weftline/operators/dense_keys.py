"""Per-key results over dense accumulator arrays, worked evenly however few keys hold most records (problem 6).

The keys are encoded by a dictionary; every input split adds its rows into arrays with one place per key, by bincount;
the splits' arrays are cut into blocks, and each block's arrays are added as a whole. No row is ever sent to "its" key, so a hot key makes no task longer:
the work follows the splits, which are of equal size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest dictionary that is sent to all executors; with more keys each split makes its own.
MAX_KEYS = 1_000_000
BLOCK = 4_096
#: Splits of one block are first added up in so many parts.
PARTS = 64


def dictionary(df: DataFrame, key: str, most: int = MAX_KEYS) -> list | None:
    """The distinct non-null keys in order, or None if there are more than ``most``. At most that many rows are fetched."""
    rows = df.filter(F.col(key).isNotNull()).select(key).distinct().limit(most + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= most else None


def _weights(batch: pa.RecordBatch, measure: str) -> tuple[np.ndarray, np.ndarray]:
    v = batch[measure].cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.isfinite(v)
    return np.where(good, v, 0.0), good


def _dense(keys: list, key: str, measures: Sequence[str]):
    """Adds a split's rows into arrays; the last place is that of null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, known, split = len(keys) + 1, None, TaskContext.get().partitionId()
        rows = np.zeros(size, np.int64)
        counts, sums = {m: np.zeros(size, np.int64) for m in measures}, {m: np.zeros(size) for m in measures}
        for batch in batches:
            if known is None:
                known = pa.array(keys, batch[key].type)
            codes = pc.fill_null(pc.index_in(batch[key], known), size - 1).to_numpy()
            rows += np.bincount(codes, minlength=size)
            for m in measures:
                v, good = _weights(batch, m)
                sums[m] += np.bincount(codes, v, size)
                counts[m] += np.bincount(codes[good], minlength=size)
        for start in range(0, size, BLOCK):
            part = slice(start, start + BLOCK)
            if rows[part].any():
                arrays = {"rows": rows[part]} | {f"n_{m}": counts[m][part] for m in measures} | {f"sum_{m}": sums[m][part] for m in measures}
                yield pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int64()), "part": pa.array([split % PARTS], pa.int32())} | {k: pa.array([a]) for k, a in arrays.items()})

    return run


def _added(names: Sequence[str]):
    """The sum of one block's arrays, batch by batch: as much memory as one block, however many splits there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        start = part = None
        for batch in batches:
            start, part, n = batch["start"][:1], batch["part"][:1], batch.num_rows
            for k in names:
                rows = batch[k].flatten().to_numpy().reshape(n, -1).sum(axis=0)
                totals[k] = totals[k] + rows if k in totals else rows
        yield pa.RecordBatch.from_pydict({"start": start, "part": part} | {k: pa.array([totals[k]]) for k in names})

    return run


def _local(key: str, measures: Sequence[str]):
    """The same with a dictionary of each batch's own keys; gives a row per key of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = batch[key].dictionary_encode()
            size = len(encoded.dictionary) + 1
            codes = pc.fill_null(encoded.indices, size - 1).to_numpy()
            columns = {"rows": np.bincount(codes, minlength=size)}
            for m in measures:
                v, good = _weights(batch, m)
                columns |= {f"n_{m}": np.bincount(codes[good], minlength=size), f"sum_{m}": np.bincount(codes, v, size)}
            own = pa.concat_arrays([encoded.dictionary, pa.nulls(1, encoded.dictionary.type)])
            out = pa.RecordBatch.from_pydict({"key": own} | {k: pa.array(v) for k, v in columns.items()})
            yield out.filter(pc.greater(out["rows"], 0))

    return run


def per_key(df: DataFrame, key: str, measures: Sequence[str] = (), most: int = MAX_KEYS) -> DataFrame:
    """One row per key, null included: key, rows, and per measure ``n_<m>`` (finite values) and ``sum_<m>`` (null if none).

    Measures are numeric; null, NaN and infinite values enter no sum. Keys are integers or strings. An empty table gives
    an empty one; extra columns are left out.
    """
    kind = dict(df.dtypes)[key]
    slim = df.select(key, *(F.col(m).cast("double").alias(m) for m in measures))
    names = ["rows", *(f"n_{m}" for m in measures), *(f"sum_{m}" for m in measures)]
    total = [F.sum(n).alias(n) for n in names]
    keys = dictionary(df, key, most)
    if keys is None:
        schema = f"key {kind}, " + ", ".join(f"`{n}` {'double' if n.startswith('sum_') else 'bigint'}" for n in names)
        summed = slim.mapInArrow(_local(key, measures), schema).groupBy("key").agg(*total)
    else:
        schema = "start bigint, part int, " + ", ".join(f"`{n}` array<{'double' if n.startswith('sum_') else 'bigint'}>" for n in names)
        blocks = slim.mapInArrow(_dense(keys, key, measures), schema)
        # In two rounds, so that a block of very many splits is never one task's alone; each round adds whole arrays.
        for by in (["start", "part"], ["start"]):
            blocks = blocks.groupBy(*by).applyInArrow(_added(names), schema)
        places = blocks.select("start", F.posexplode(F.arrays_zip(*names)).alias("at", "x")).filter("x.rows > 0").select((F.col("start") + F.col("at")).alias("code"), "x.*")
        codes = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate([*keys, None])], f"code bigint, key {kind}")
        summed = places.join(codes, "code").drop("code")
    return summed.select("key", "rows", *(c for m in measures for c in (F.col(f"n_{m}"), F.when(F.col(f"n_{m}") > 0, F.col(f"sum_{m}")).alias(f"sum_{m}"))))


def regroup(totals: DataFrame, groups: DataFrame) -> DataFrame:
    """Sums per-key rows into the groups their keys belong to (groups: key, group; a key once); null without a group."""
    names = [c for c in totals.columns if c != "key"]
    return totals.join(groups, "key", "left").groupBy("group").agg(*(F.sum(n).alias(n) for n in names)).withColumnRenamed("group", "key")
