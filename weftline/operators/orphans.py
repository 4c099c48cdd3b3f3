"""References to records that do not exist, tracked by keyed state (problem 3).

The state holds, per field and key, how many references have arrived and how many of them wait for their parent. A period
takes its references and the index of parents as it is known by then: new references probe the index at their own arrival; a
parent that arrives resolves what waits for it, be it listed in the period or learnt of late; one that is deleted, or gone from
the index, reopens all references to it. Of one key either all references wait or none does, so the counts of the last period
tell what changed since, and the periods may be cut anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.enrich import lookup
from weftline.sources.shared import kept

STATE_SCHEMA = "field_name string, key bigint, n_arrived bigint, n_pending bigint"
KINDS = ("missing", "deleted", "later")


def parent_index(parents: DataFrame, key: str, listed: str, delisted: str) -> DataFrame:
    """One row per key with its listings as an array of (listed, delisted), repeated ones once, in order.

    A null ``listed`` stands for the beginning of time, a null ``delisted`` for its end; null keys are left out.
    """
    return (
        parents.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("bigint").alias("key"))
        .agg(F.array_sort(F.collect_set(F.struct(F.col(listed).alias("listed"), F.col(delisted).alias("delisted")))).alias("listings"))
    )


def references(df: DataFrame, row_id: str, fields: list[str], at: str) -> DataFrame:
    """One row per non-null reference: row_id, field_name, key, at; repeated rows are references of their own."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("bigint").alias("key")) for f in fields))
    return df.select(F.col(row_id).alias("row_id"), F.col(at).alias("at"), F.inline(pairs)).filter(F.col("key").isNotNull())


def _started(x: Column, at: Column) -> Column:
    return x["listed"].isNull() | (x["listed"] <= at)


def _ended(x: Column, at: Column) -> Column:
    return F.coalesce(x["delisted"] <= at, F.lit(False))


def _in_effect(listings: Column, at: Column) -> Column:
    return F.exists(listings, lambda x: _started(x, at) & ~_ended(x, at))


def _kind(listings: Column, at: Column) -> Column:
    return (
        F.when(listings.isNull(), "missing")
        .when(at.isNull() | _in_effect(listings, at), None)
        .when(F.exists(listings, lambda x: _ended(x, at)), "deleted")
        .otherwise("later")
    )


def _moment(text: str | None) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def timeline(index: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """The index with, per key, whether it is in effect just before ``since``, and the changes of that in [since, until), in
    order, as (at, on). Of overlapping listings only what changes the whole counts."""
    start, end, x = _moment(since), _moment(until), F.col("listings")
    before = F.exists(x, lambda e: e["listed"].isNull()) if since is None else F.exists(x, lambda e: (e["listed"].isNull() | (e["listed"] < start)) & (e["delisted"].isNull() | (e["delisted"] >= start)))
    inside = lambda t: t.isNotNull() & (F.lit(since is None) | (t >= start)) & (F.lit(until is None) | (t < end))
    times = F.array_sort(F.array_distinct(F.filter(F.concat(F.transform(x, lambda e: e["listed"]), F.transform(x, lambda e: e["delisted"])), inside)))
    states = F.transform(times, lambda t: F.struct(t.alias("at"), _in_effect(x, t).alias("on")))
    known = index.select("key", "listings", F.coalesce(before, F.lit(False)).alias("before"), states.alias("states"))
    earlier = lambda i: F.when(i == 0, F.col("before")).otherwise(F.get(F.col("states"), i - 1)["on"])
    return known.select("key", "listings", "before", F.filter("states", lambda s, i: s["on"] != earlier(i)).alias("changes"))


def arrivals(refs: DataFrame, index: DataFrame, cuts: Sequence[str | None]) -> DataFrame:
    """What new references find as they probe the index, from one scan: period, field_name, key, segment, month, kind, row_id,
    at, n. The periods are [cuts[i], cuts[i + 1]), texts ``YYYY-MM-DD HH:MM:SS``; None is unbounded, at the ends only.

    References that find their parent are counted per key and segment (the number of changes before them in the period) before
    any shuffle; those that don't come one by one (row_id, at), repeated ones with their number. So a hot key costs no more
    than any other. A reference without arrival time can only be ``missing``; it comes, without a month, in a first period
    that has no beginning.
    """
    first, last, inner = cuts[0], cuts[-1], cuts[1:-1]
    at = F.col("at")
    inside = at.isNotNull() & (F.lit(first is None) | (at >= _moment(first))) & (F.lit(last is None) | (at < _moment(last)))
    period = sum((F.when(at >= _moment(c), 1).otherwise(0) for c in inner), F.lit(0))
    begins = F.get(F.array(*(_moment(c) for c in cuts[:-1])), period)
    whole = lookup(timeline(index, first, last).select("key", "listings", "changes"))
    probed = refs.filter(inside | (at.isNull() if first is None else F.lit(False))).join(whole, "key", "left")
    probed = probed.withColumns({"kind": _kind(F.col("listings"), at), "period": F.when(at.isNull(), 0).otherwise(period)})
    segment = F.coalesce(F.size(F.filter("changes", lambda c: (c["at"] <= at) & (begins.isNull() | (c["at"] >= begins)))), F.lit(0))
    segment = F.when(F.col("changes").isNull(), 0).otherwise(segment)
    orphan = F.col("kind").isNotNull()
    group = ["period", "field_name", "key", segment.alias("segment"), F.date_format("at", "yyyy-MM").alias("month"), "kind", F.when(orphan, F.col("row_id")).alias("row_id"), F.when(orphan, at).alias("at")]
    return probed.filter(orphan | at.isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))


def opened(arrived: DataFrame) -> DataFrame:
    """row_id, field_name, key, at, kind of the references that wait or have no parent, one row each."""
    some = arrived.filter(F.col("kind").isNotNull())
    return some.select("row_id", "field_name", "key", "at", "kind", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_copy")).drop("_copy")


def counted(arrived: DataFrame) -> DataFrame:
    """What settle() needs of the arrivals: their numbers alone."""
    return arrived.groupBy("period", "field_name", "key", "segment", "month", "kind").agg(F.sum("n").alias("n"))


def settle(state: DataFrame | None, arrived: DataFrame, index: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """One period, its arrivals or their numbers, applied to the state: rows of the state after it (field_name, key, n_arrived, n_pending) and of what moved
    (month, field_name, move, n), the columns of the others being null.

    Moves are ``opened_missing``, ``opened_deleted``, ``opened_later``, ``resolved`` and ``reopened``. A parent that was in effect
    at the end of the last period and isn't at the beginning of this one, or the other way round, was learnt of late: it moves
    what has arrived so far in the month in which this period begins.
    """
    dated = arrived.filter(F.col("month").isNotNull())
    parts = dated.groupBy("field_name", "key", "segment").agg(F.sum("n").alias("n")).groupBy("field_name", "key").agg(F.collect_list(F.struct("segment", "n")).alias("parts"))
    if state is None:
        state = arrived.sparkSession.createDataFrame([], STATE_SCHEMA)
    keyed = parts.join(state.select("field_name", "key", "n_arrived", "n_pending"), ["field_name", "key"], "full").join(timeline(index, since, until).drop("listings"), "key", "left")
    old = F.coalesce("n_arrived", F.lit(0))
    so_far = lambda segment: old + F.aggregate(F.filter(F.coalesce("parts", F.array().cast("array<struct<segment:int,n:bigint>>")), lambda p: p["segment"] <= segment), F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    keyed = keyed.withColumns({"before": F.coalesce("before", F.lit(False)), "changes": F.coalesce("changes", F.array().cast("array<struct<at:timestamp_ntz,on:boolean>>"))})
    move = lambda on: F.when(on, "resolved").otherwise("reopened")
    late = F.filter(F.array(F.struct(_moment(since).alias("at"), F.col("before").alias("on"), old.alias("n"))), lambda x: (x["n"] > 0) & (x["on"] != (F.col("n_pending") == 0)))
    events = F.concat(late, F.transform("changes", lambda c, i: F.struct(c["at"].alias("at"), c["on"].alias("on"), so_far(i).alias("n"))))
    flows = keyed.select("field_name", F.inline(events)).filter("n > 0").select(F.date_format("at", "yyyy-MM").alias("month"), "field_name", move(F.col("on")).alias("move"), "n")
    news = dated.filter(F.col("kind").isNotNull()).select("month", "field_name", F.concat(F.lit("opened_"), F.col("kind")).alias("move"), "n")
    moves = news.unionByName(flows).groupBy("month", "field_name", "move").agg(F.sum("n").alias("n"))
    on = F.when(F.size("changes") > 0, F.element_at("changes", -1)["on"]).otherwise(F.col("before"))
    total = so_far(F.lit(2**31 - 1))
    after = keyed.select("field_name", "key", total.alias("n_arrived"), F.when(on, 0).otherwise(total).cast("bigint").alias("n_pending"))
    return after.unionByName(moves, allowMissingColumns=True)


def state_of(settled: DataFrame) -> DataFrame:
    return settled.filter(F.col("move").isNull()).select("field_name", "key", "n_arrived", "n_pending")


def moves_of(settled: DataFrame) -> DataFrame:
    return settled.filter(F.col("move").isNotNull()).select("month", "field_name", "move", "n")


@dataclass(frozen=True)
class Step:
    """What a step gives: the new references that wait or have no parent (row_id, field_name, key, at, kind), the new
    state, and the counts it moved by month, field and kind of movement."""

    opened: DataFrame
    state: DataFrame
    moves: DataFrame


def advance(state: DataFrame | None, refs: DataFrame, index: DataFrame, since: str | None = None, until: str | None = None) -> Step:
    """One period over the references of [since, until). They are scanned once, and what they find is kept in the shared folder.

    An empty table gives empty results; extra columns don't matter.
    """
    arrived = kept(arrivals(refs, index, [since, until]))
    settled = kept(settle(state, arrived, index, since, until))
    return Step(opened(arrived), state_of(settled), moves_of(settled))


def snapshots(moves: DataFrame) -> DataFrame:
    """Per field and month: what was opened by kind, resolved and reopened, and what waits at the month's end."""
    n = lambda name: F.coalesce(F.sum(F.when(F.col("move") == name, F.col("n"))), F.lit(0)).alias(name)
    table = moves.groupBy("field_name", "month").agg(*(n(f"opened_{k}") for k in KINDS), n("resolved"), n("reopened"))
    change = F.col("opened_missing") + F.col("opened_deleted") + F.col("opened_later") + F.col("reopened") - F.col("resolved")
    return table.withColumn("pending", F.sum(change).over(Window.partitionBy("field_name").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)))
