import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from weftline.operators import orphans
from weftline.sources.store import Store
from weftline.streaming.incremental import OrphanTracker

T0 = datetime(2024, 1, 1)
FIELDS = ["a", "b"]


def brute(refs, parents):
    """Reference by reference, event by event."""
    listings = {k: sorted({(x, y) for q, x, y in parents if q == k}, key=str) for k, _, _ in parents if k is not None}
    opened, moves = [], Counter()
    for row, key, field, at in refs:
        own = listings.get(key)
        on = own and any((x is None or x <= at) and not (y is not None and y <= at) for x, y in own)
        if not own:
            kind = "missing"
        elif on:
            kind = None
        else:
            kind = "deleted" if any(y is not None and y <= at for _, y in own) else "later"
        waits = kind is not None
        if kind:
            opened.append((row, field, kind))
            moves[at.strftime("%Y-%m"), field, "opened_" + kind] += 1
        for t in sorted({t for x in own or () for t in x if t is not None and t > at}):
            listed = any(x == t for x, _ in own)
            if listed and waits:
                moves[t.strftime("%Y-%m"), field, "resolved"] += 1
            elif not listed and not waits:
                moves[t.strftime("%Y-%m"), field, "reopened"] += 1
            waits = not listed
    return sorted(opened), dict(moves)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    day = lambda n: T0 + timedelta(days=n)
    parents = [(1, day(-400), None), (1, day(-400), None), (2, day(-400), day(40)), (3, day(50), None), (4, day(-10), day(20)), (4, day(60), None), (5, None, day(33)), (None, day(0), None)]
    rows = []
    for i in range(3000):
        key = 2 if rng.random() < 0.4 else rng.choice([1, 2, 3, 4, 5, 6, None])
        rows.append((i, key, rng.choice([1, 3, None]), T0 + timedelta(seconds=rng.randrange(100 * 86400))))
    rows.append((3000, 2, 3, day(40)))  # at the very moment of the deletion
    rows.append((3001, 3, 2, day(50)))  # at the very moment of the listing
    df = spark.createDataFrame(rows, "id long, a int, b int, at timestamp_ntz")
    index = orphans.parent_index(spark.createDataFrame(parents, "k int, x timestamp_ntz, y timestamp_ntz"), "k", "x", "y")
    flat = [(r[0], r[1 + j], f, r[3]) for r in rows for j, f in enumerate(FIELDS) if r[1 + j] is not None]
    return orphans.references(df, "id", FIELDS, "at"), index, brute(flat, parents)


def counts(moves):
    return {(r["month"], r["field_name"], r["move"]): r["n"] for r in moves.collect()}


def test_one_step_equals_brute_force(case):
    refs, index, (opened, moves) = case
    step = orphans.advance(None, refs, index)
    assert sorted((r["row_id"], r["field_name"], r["kind"]) for r in step.opened.collect()) == opened
    assert counts(step.moves) == moves


def total_moves(tracker):
    total = Counter()
    for r in tracker._all("moves").collect():
        total[r["month"], r["field_name"], r["move"]] += r["n"]
    return dict(total)


CUTS = [None, "2024-01-21 00:00:00", "2024-02-10 00:00:00", "2024-03-01 12:00:00", None]


@pytest.mark.parametrize("spans", [[CUTS], list(zip(CUTS, CUTS[1:])), [CUTS[:3], CUTS[2:]]])
def test_periods_equal_one_step(spark, case, tmp_path, spans):
    refs, index, (opened, moves) = case
    tracker = OrphanTracker(Store(spark, str(tmp_path)))
    found = []
    for cuts in spans:
        found += [(r["row_id"], r["field_name"], r["kind"]) for r in tracker.advance(refs, index, *cuts).collect()]
    assert sorted(found) == opened and total_moves(tracker) == moves
    assert sorted((r["row_id"], r["field_name"], r["kind"]) for r in tracker.opened().collect()) == opened
    step = orphans.advance(None, refs, index)
    whole = orphans.snapshots(step.moves).orderBy("field_name", "month").collect()
    assert tracker.snapshots().orderBy("field_name", "month").collect() == whole
    assert sorted(map(tuple, tracker.state().collect())) == sorted(map(tuple, step.state.collect()))
    last = {f: [r["pending"] for r in whole if r["field_name"] == f][-1] for f in FIELDS}
    assert {f: sum(s["n_pending"] for s in tracker.state().collect() if s["field_name"] == f) for f in FIELDS} == last
    assert len(tracker.store.batches("orphans/state")) <= 2


def frames(spark, rows, parents):
    refs = orphans.references(spark.createDataFrame(rows, "id long, a int, b int, at timestamp_ntz"), "id", FIELDS, "at")
    return refs, orphans.parent_index(spark.createDataFrame(parents, "k int, x timestamp_ntz, y timestamp_ntz"), "k", "x", "y")


def test_parents_that_are_learnt_of_late(spark, tmp_path):
    """References of January; their parents come to be known in February, listed on the first of January, or without a date. In
    March one is gone from the index again."""
    day = lambda m, d: datetime(2024, m, d)
    refs, none = frames(spark, [(1, 7, None, day(1, 5)), (2, 8, None, day(1, 6)), (3, 8, None, day(2, 20)), (4, 9, None, day(1, 7))], [])
    later = frames(spark, [], [(7, T0, None), (8, None, None)])[1]
    gone = frames(spark, [], [(7, T0, None)])[1]
    tracker = OrphanTracker(Store(spark, str(tmp_path)))
    state = lambda: {r["key"]: (r["n_arrived"], r["n_pending"]) for r in tracker.state().collect()}
    tracker.advance(refs, none, None, "2024-02-01 00:00:00")
    assert state() == {7: (1, 1), 8: (1, 1), 9: (1, 1)}
    opened = tracker.advance(refs, later, "2024-02-01 00:00:00", "2024-03-01 00:00:00")
    assert opened.count() == 0 and state() == {7: (1, 0), 8: (2, 0), 9: (1, 1)}
    tracker.advance(refs, gone, "2024-03-01 00:00:00", "2024-04-01 00:00:00")
    assert state() == {7: (1, 0), 8: (2, 2), 9: (1, 1)}
    assert total_moves(tracker) == {("2024-01", "a", "opened_missing"): 3, ("2024-02", "a", "resolved"): 2, ("2024-03", "a", "reopened"): 2}


def test_a_span_applied_again_replaces_itself(spark, case, tmp_path):
    refs, index, _ = case
    tracker = OrphanTracker(Store(spark, str(tmp_path)))
    spans = [(None, CUTS[1]), (CUTS[1], CUTS[2])]
    for cuts in spans:
        tracker.advance(refs, index, *cuts)
    state, moves = sorted(map(tuple, tracker.state().collect())), total_moves(tracker)
    tracker.advance(refs, index, *spans[1])
    assert sorted(map(tuple, tracker.state().collect())) == state and total_moves(tracker) == moves
    for cuts in (spans[0], (CUTS[1], CUTS[3]), (CUTS[3], None), (CUTS[2], CUTS[1]), (CUTS[2],)):
        with pytest.raises(ValueError):
            tracker.advance(refs, index, *cuts)
    assert total_moves(tracker) == moves


def test_overlapping_listings_and_repeated_references(spark):
    day = lambda n: T0 + timedelta(days=n)
    refs, index = frames(spark, [(1, 1, None, day(5)), (1, 1, None, day(25)), (1, 1, None, day(25)), (2, 1, None, day(40))], [(1, day(0), day(20)), (1, day(10), day(30)), (1, day(12), day(15)), (1, day(30), day(30))])
    step = orphans.advance(None, refs, index)
    assert sorted((r["row_id"], r["kind"]) for r in step.opened.collect()) == [(2, "deleted")]
    assert counts(step.moves) == {("2024-01", "a", "reopened"): 3, ("2024-02", "a", "opened_deleted"): 1}
    repeated, _ = frames(spark, [(1, 5, None, day(1)), (1, 5, None, day(1))], [])
    assert orphans.advance(None, repeated, index).opened.count() == 2


def test_nulls_and_empty(spark):
    refs = orphans.references(spark.createDataFrame([(1, 9, None, None), (2, None, None, T0)], "id long, a int, b int, at timestamp_ntz"), "id", FIELDS, "at")
    index = orphans.parent_index(spark.createDataFrame([], "k int, x timestamp_ntz, y timestamp_ntz"), "k", "x", "y")
    step = orphans.advance(None, refs, index)
    assert [(r["row_id"], r["kind"]) for r in step.opened.collect()] == [(1, "missing")]
    assert counts(step.moves) == {} and step.state.count() == 0
    assert orphans.snapshots(orphans.advance(None, refs.limit(0), index).moves).count() == 0
