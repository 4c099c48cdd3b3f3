from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions.temporal import clock_seconds, with_instant
from weftline.operators import instants

NY = ZoneInfo("America/New_York")


def us(*parts, zone=UTC):
    return int(datetime(*parts, tzinfo=zone).timestamp() * 1_000_000)


CASES = [
    ("2024-01-02 03:04:05", us(2024, 1, 2, 3, 4, 5, zone=NY), "ok"),
    ("  2024-01-02 03:04:05 ", us(2024, 1, 2, 3, 4, 5, zone=NY), "ok"),
    ("2024-01-02T03:04:05.123456", us(2024, 1, 2, 3, 4, 5, 123456, zone=NY), "ok"),
    ("2024-07-02T03:04:05Z", us(2024, 7, 2, 3, 4, 5), "ok"),
    ("2024-07-02T03:04:05.039+0000", us(2024, 7, 2, 3, 4, 5, 39000), "ok"),
    ("2024-07-02 03:04:05+05:30", us(2024, 7, 1, 21, 34, 5), "ok"),
    ("2024-07-02T03:04:05-0400", us(2024, 7, 2, 7, 4, 5), "ok"),
    ("2024-07-02 03:04:05 EST", us(2024, 7, 2, 8, 4, 5), "ok"),
    ("2024-07-02 03:04:05 America/New_York", us(2024, 7, 2, 3, 4, 5, zone=NY), "ok"),
    ("07/02/2024 12:04:05 AM", us(2024, 7, 2, 0, 4, 5, zone=NY), "ok"),
    ("02.07.2024 13:04", us(2024, 7, 2, 13, 4, zone=NY), "ok"),
    ("Jul 2, 2024 1:04 pm", us(2024, 7, 2, 13, 4, zone=NY), "ok"),
    ("Tue, 02 Jul 2024 03:04:05 GMT", us(2024, 7, 2, 3, 4, 5), "ok"),
    ("20240702030405", us(2024, 7, 2, 3, 4, 5, zone=NY), "ok"),
    ("1719889445", 1719889445_000_000, "ok"),
    ("1719889445123", 1719889445_123_000, "ok"),
    ("2024-366 10:00", us(2024, 12, 31, 10, zone=NY), "ok"),
    ("2023-366 10:00", None, "unreadable"),
    ("2024-02-30 10:00:00", None, "unreadable"),
    ("2024-01-01 24:00:00", None, "unreadable"),
    ("2024-01-01 13:00 PM", None, "unreadable"),
    ("2024-03-10 02:30:00", None, "skipped"),
    ("2024-11-03 01:30:00", None, "repeated"),
    ("2024-11-03 01:30:00 EDT", us(2024, 11, 3, 5, 30), "ok"),
    ("2024-11-03 02:00:00", us(2024, 11, 3, 7), "ok"),
    ("2024-10-27 02:30 Europe/Berlin", None, "repeated"),
    ("2024-07-02 03:04 Nowhere/Town", None, "unknown_zone"),
    ("2024-03-01 12:00:00 America/Phoenix", us(2024, 3, 1, 19), "ok"),
    ("2024-03-01 12:00:00 asia/singapore", us(2024, 3, 1, 4), "ok"),
    ("2024-03-01 12:00:00 Etc/GMT+5", us(2024, 3, 1, 17), "ok"),
    ("2024-03-01 12:00:00 America/Argentina/Buenos_Aires", us(2024, 3, 1, 15), "ok"),
    ("2024-03-01 12:00:00 Japan", us(2024, 3, 1, 3), "ok"),
    ("2024-03-01 12:00:00+99:99", None, "unreadable"),
    ("2024-03-01 12:00:00-0560", None, "unreadable"),
    ("2024-03-01 12:00:00+14:00", us(2024, 2, 29, 22), "ok"),
    ("2024-03-01 12:00:00+14:01", None, "unreadable"),
    ("1719889445123456", 1719889445_123_456, "ok"),
    ("1719889445123456789", 1719889445_123_456, "ok"),
    ("20241302030405", None, "unreadable"),
    ("unknown", None, "unreadable"),
    ("2024-07-02", None, "unreadable"),
    ("", None, "absent"),
    (None, None, "absent"),
    ("9" * 5000, None, "unreadable"),
]


def run(spark, values, zone="America/New_York"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [(r["t_utc_us"], r["t_status"]) for r in with_instant(df, F.col("v"), zone).orderBy("i").collect()]


def test_notations(spark):
    got = run(spark, [c[0] for c in CASES])
    assert got == [c[1:] for c in CASES]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 2_000_000_000), min_size=20, max_size=60))
def test_same_instant_in_every_notation(spark, seconds):
    """Against Python's own zones, whole hours around clock changes included."""
    seconds += [us(2024, 3, 10, 6, 30) // 10**6 + 1800 * k for k in range(6)] + [us(2024, 11, 3, 4) // 10**6 + 1800 * k for k in range(8)]
    rows, want = [], []
    for s in seconds:
        utc = datetime.fromtimestamp(s, UTC)
        wall = utc.astimezone(NY).replace(tzinfo=None)
        if wall.year < 1971:
            continue
        both = {(wall.replace(tzinfo=NY, fold=f) - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1) for f in (0, 1)}
        local = (s * 10**6, "ok") if len(both) == 1 else (None, "repeated")
        whole = (s * 10**6 - utc.second * 10**6, "ok") if local[0] is not None else local
        for text, expected in (
            (f"{wall:%Y-%m-%d %H:%M:%S}", local),
            (f"{wall:%m/%d/%Y %I:%M:%S %p}", local),
            (f"{wall:%d.%m.%Y %H:%M}", whole),
            (f"{wall:%b} {wall.day}, {wall:%Y %I:%M %p}", whole),
            (f"{utc:%a, %d %b %Y %H:%M:%S} GMT", (s * 10**6, "ok")),
            (f"{utc:%Y-%m-%dT%H:%M:%S}Z", (s * 10**6, "ok")),
            (f"{utc:%Y-%j %H:%M:%S} UTC", (s * 10**6, "ok")),
        ):
            rows.append(text)
            want.append(expected)
    assert run(spark, rows) == want


def test_clock_names(spark):
    values = ["08:00", "8:00 pm", "13:00 pm", "0:30 am", "12:30 AM", "2359", "2400", "18:00-05:00", "00:00 EDT", "99:99", "08:3O", "", None, " 08:00 ", "10:00 XYZ", "10:00+99:99", "10:00 America/Phoenix", "1:02:03 pm"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(clock_seconds(F.col("v"))).collect()]
    assert got == [28800, 72000, None, None, 1800, 86340, None, 64800, 0, None, None, None, None, 28800, None, None, 36000, 46923]


def test_found_cases_and_whole_rows(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:00 ", "b"), (2, "2024-01-01 00:00:00 ", "b"), (3, None, None), (4, "2024-03-10 02:10:00", "c"), (5, "N/A", "d")],
        "row_id long, pickup_datetime string, t_status string",  # a clashing name is replaced
    )
    out = instants.trips(df)
    assert out.count() == 6 and out.columns.count("t_status") == 1
    got = sorted(tuple(r) for r in instants.rewritten(out, "taxi_trips").collect())
    assert got == [("taxi_trips", 2, 1704085200_000_000), ("taxi_trips", 2, 1704085200_000_000), ("taxi_trips", 4, -1)]


def test_offset_in_time_holds_for_the_date(spark):
    df = spark.createDataFrame([(1, "01-Feb-2024", "23:00-05:00"), (2, "2024-02-01", None), (3, None, "10:00"), (4, "2024-02-01", "10:00"), (5, "2024-032", "1000"), (6, "20240201", "10:00 AM")], "row_id long, date_gmt string, time_gmt string")
    got = {r["row_id"]: (r["t_utc_us"], r["t_plain"]) for r in instants.air_quality(df).collect()}
    ten = us(2024, 2, 1, 10)
    assert got == {1: (us(2024, 2, 2, 4), False), 2: (None, False), 3: (None, False), 4: (ten, True), 5: (ten, False), 6: (ten, False)}


def test_empty_and_filter_does_not_repeat_the_steps(spark):
    empty = spark.createDataFrame([], "row_id long, pickup_datetime string")
    assert instants.rewritten(instants.trips(empty), "taxi_trips").count() == 0
    joined = instants.trips(empty).join(empty.select(F.col("row_id").alias("t_utc_us"), F.lit(1).alias("x")), "t_utc_us", "left")
    assert joined.count() == 0  # the optimiser follows no join key down the steps
    plan = instants.rewritten(instants.trips(empty), "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 4
