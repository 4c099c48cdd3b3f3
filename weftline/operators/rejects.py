"""Rows that fail to parse, set apart with their reasons while the valid rows load (problem 5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.temporal import clock_seconds

#: A line of whole quoted fields (quotes doubled inside) and fields without any quote.
SOUND_QUOTING = r'\A(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*\z'
def _stand_ins(values: pa.Array) -> dict[str, str]:
    """For each kind of line break in the lines, a character of private use that none of them has."""
    breaks = [b for b in "\n\r" if pc.any(pc.match_substring(values, b)).as_py()]
    free = (chr(c) for c in (*range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE)) if not pc.any(pc.match_substring(values, chr(c))).as_py())
    return {b: next(free) for b in breaks}


def whole_number(value: Column, low: int, high: int) -> Column:
    """A text of plain digits (leading zeros and outer blanks allowed) as a number within low..high, else null."""
    digits = F.trim(value)
    number = F.when(digits.rlike(r"\A[0-9]+\z"), F.regexp_replace(digits, r"\A0+(?=[0-9])", "")).try_cast("int")
    return F.when(number.between(low, high), number)


#: Casts of cells: a value, or null where the text isn't one.
HOUR = lambda c: whole_number(c, 0, 23)
COUNTY = lambda c: whole_number(c, 1, 999)
CLOCK = clock_seconds


@dataclass(frozen=True)
class Cast:
    """A text column cast to a new one; ``reason`` is the label of a cell that isn't null and can't be cast."""

    source: str
    name: str
    reason: str
    cast: Callable[[Column], Column]


def with_casts(df: DataFrame, casts: Sequence[Cast], structural: Column | None = None) -> DataFrame:
    """Adds the casts, and ``reasons array<string>``: the structural reason alone where there is one, else a label per failing
    cell. All rows and columns stay; an empty array marks a valid row. A null cell fails no cast.

    As casts and array are tied to the partition id, a filter on them doesn't run the casts a second time. A column that
    already has one of the names is replaced.
    """
    once = F.spark_partition_id() >= 0
    typed = df.withColumns({c.name: F.when(once, c.cast(F.col(f"`{c.source}`"))) for c in casts})
    failing = F.filter(F.array(*(F.when(F.col(f"`{c.source}`").isNotNull() & F.col(c.name).isNull(), F.lit(c.reason)) for c in casts)), lambda r: r.isNotNull())
    reasons = failing if structural is None else F.when(structural.isNotNull(), F.array(structural)).otherwise(failing)
    return typed.withColumn("reasons", F.when(once, reasons))


def split_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, without their empty reasons, and rejected rows with them."""
    return df.filter(F.size("reasons") == 0).drop("reasons"), df.filter(F.size("reasons") > 0)


def parse_lines(df: DataFrame, key: str, dataset: str, line: str, layouts: Mapping[str, Sequence[str]], kept: Sequence[str]) -> DataFrame:
    """Reads each line alone as comma-separated text with double quotes, fields as strings.

    Columns: key, dataset, ``structure`` (null; ``no_line`` for null; ``unknown_dataset``; ``broken_quoting``; or
    ``field_count:<n>``) and one string per name of ``kept`` that some layout has (null where the row has no such field, or
    the field is empty and unquoted or quoted). Lines of sound quoting are handed to the CSV reader a batch at a time, its
    callback taking those of another field count; lines of broken quoting are kept from it, as they would run into the next.
    Line breaks at the end of a line are dropped; inside it they are part of a field.
    """
    types = dict(df.dtypes)

    def parsed(values: pa.Array, names: Sequence[str]) -> tuple[list[str | None], dict[str, pa.Array]]:
        """Structural reasons of the lines of one layout, and their kept fields."""
        n = len(values)
        reasons: list[str | None] = [None] * n
        stand_ins = _stand_ins(values)
        for mark, stand_in in stand_ins.items():
            values = pc.replace_substring(values, mark, stand_in)
        sound = pc.match_substring_regex(values, SOUND_QUOTING)
        empty = pc.equal(values, "")
        for i in pc.indices_nonzero(pc.invert(sound)).to_pylist():
            reasons[i] = "broken_quoting"
        for i in pc.indices_nonzero(empty).to_pylist():
            reasons[i] = "field_count:1"
        taken = pc.indices_nonzero(pc.and_(sound, pc.invert(empty)))
        fields = {k: pa.nulls(n, pa.string()) for k in kept if k in names}
        if not len(taken):
            return reasons, fields
        at, wrong = taken.to_pylist(), {}

        def reject(row: pacsv.InvalidRow) -> str:
            wrong[row.number - 1] = row.actual_columns
            return "skip"

        data = pa.py_buffer(("\n".join(values.take(taken).to_pylist()) + "\n").encode())
        table = pacsv.read_csv(
            pa.BufferReader(data),
            pacsv.ReadOptions(use_threads=False, column_names=list(names), block_size=data.size + 1),
            pacsv.ParseOptions(invalid_row_handler=reject, ignore_empty_lines=False, newlines_in_values=False),
            pacsv.ConvertOptions(column_types={c: pa.string() for c in names}, include_columns=list(fields), strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True),
        )
        for k, count in wrong.items():
            reasons[at[k]] = f"field_count:{count}"
        good = pa.array([i for k, i in enumerate(at) if k not in wrong], pa.int64())
        place = [None] * n
        for k, i in enumerate(good.to_pylist()):
            place[i] = k
        where = pa.array(place, pa.int64())
        for k in fields:
            column = table[k].combine_chunks().take(where)
            for mark, stand_in in stand_ins.items():
                column = pc.replace_substring(column, stand_in, mark)
            fields[k] = column
        return reasons, fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = pc.utf8_rtrim(batch[line].cast(pa.string()), "\r\n")
            parts, orders = [], []
            names_of = batch[dataset].cast(pa.string())
            known = pc.and_kleene(pc.is_in(names_of, pa.array(list(layouts))), pc.is_valid(lines))
            for name, names in layouts.items():
                rows = pc.indices_nonzero(pc.fill_null(pc.and_kleene(known, pc.equal(names_of, name)), False))
                if len(rows):
                    reasons, fields = parsed(lines.take(rows), names)
                    parts.append(pa.table({"structure": pa.array(reasons, pa.string())} | {k: fields.get(k, pa.nulls(len(rows), pa.string())) for k in kept}))
                    orders.append(rows)
            rows = pc.indices_nonzero(pc.invert(pc.fill_null(known, False)))
            if len(rows):
                missing = pc.is_null(lines.take(rows))
                parts.append(pa.table({"structure": pc.if_else(missing, "no_line", "unknown_dataset")} | {k: pa.nulls(len(rows), pa.string()) for k in kept}))
                orders.append(rows)
            if not parts:
                continue
            order = pa.concat_arrays([o.cast(pa.int64()) for o in orders])
            out = pa.concat_tables(parts).append_column(key, batch[key].take(order)).append_column(dataset, names_of.take(order))
            yield from out.select([key, dataset, "structure", *kept]).combine_chunks().to_batches()

    schema = f"`{key}` {types[key]}, `{dataset}` string, structure string, " + ", ".join(f"`{k}` string" for k in kept)
    return df.select(key, dataset, line).mapInArrow(run, schema)
