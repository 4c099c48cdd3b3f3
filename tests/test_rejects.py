import csv
import random
import re

from pyspark.sql import functions as F

from city import rejects_keys as P
from weftline.operators import rejects

LAYOUTS = {"w": ["a", "b", "c"], "q": ["a", "x"]}


def parse(spark, lines):
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(lines)], "id long, ds string, line string")
    return {r["id"]: r for r in rejects.parse_lines(df, "id", "ds", "line", LAYOUTS, ["a", "b", "c", "x"]).collect()}


def test_reasons_and_fields(spark):
    lines = [
        ("w", "1,2,3"), ("w", '"1,5","say ""hi""",'), ("w", "1,2"), ("w", "1,2,3,4"), ("w", ""), ("w", " "), ("w", ',,'),
        ("w", '1,"2,3'), ("w", '1,2"x,3'), ("w", '1, "2",3'), ("w", "1,2,3\r\n"), ("w", '1,"a\nb",3'), ("q", "1,2"), ("q", "1,2,3"),
        ("z", "1,2"), (None, "1"), ("w", None), ("w", "1,2," + "x" * 300_000),
    ]
    got = parse(spark, lines)
    assert [got[i]["structure"] for i in range(len(lines))] == [
        None, None, "field_count:2", "field_count:4", "field_count:1", "field_count:1", None,
        "broken_quoting", "broken_quoting", "broken_quoting", None, None, None, "field_count:3",
        "unknown_dataset", "unknown_dataset", "no_line", None,
    ]
    assert (got[1]["a"], got[1]["b"], got[1]["c"]) == ("1,5", 'say "hi"', None)
    assert got[10]["c"] == "3" and got[11]["b"] == "a\nb" and got[12]["x"] == "2" and got[12]["b"] is None
    assert len(got[17]["c"]) == 300_000


def test_random_lines_against_the_csv_module(spark):
    rng = random.Random(11)
    lines = [("w", "".join(rng.choice('12,,"" x') for _ in range(rng.randrange(0, 14)))) for _ in range(2500)]
    sound = re.compile(r'(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*')
    got = parse(spark, lines)
    for i, (_, text) in enumerate(lines):
        if not sound.fullmatch(text):
            assert got[i]["structure"] == "broken_quoting", text
            continue
        fields = next(csv.reader([text]), []) or [""]
        assert got[i]["structure"] == (None if len(fields) == 3 else f"field_count:{len(fields)}"), text
        if len(fields) == 3:
            assert [got[i][c] or "" for c in "abc"] == fields, text


def test_whole_numbers(spark):
    values = ["0", "23", "24", " 07 ", "007", "-1", "1.0", "0x1", "", "9" * 50, None, "1 2", "000000000000000000000000000005"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(rejects.HOUR(F.col("v"))).collect()]
    assert got == [0, 23, None, 7, 7, None, None, None, None, None, None, None, 5]


def test_nothing_is_lost(spark, small):
    for name, check in P.CHECKS.items():
        df = check(spark, small)
        good, bad = rejects.split_rows(df)
        assert good.count() + bad.count() == spark.read.parquet(f"{small}/{name}.parquet").count()


def test_empty(spark):
    assert parse(spark, []) == {}


def test_line_breaks_and_characters_that_could_stand_for_them(spark):
    odd = "\ue000\ue001\ue00a\ue00d"
    got = parse(spark, [("w", f'1,"a\nb\r{odd}",3'), ("w", f"{odd},2,3")])
    assert got[0]["b"] == f"a\nb\r{odd}" and got[1]["a"] == odd


def test_casts_and_reasons(spark):
    df = spark.createDataFrame([(1, "07", "8:00 PM"), (2, "24", "x"), (3, None, None)], "id int, h string, c string")
    casts = [rejects.Cast("h", "hour", "bad_hour", rejects.HOUR), rejects.Cast("c", "s", "bad_clock", rejects.CLOCK)]
    good, bad = rejects.split_rows(rejects.with_casts(df, casts))
    assert [(r["id"], r["hour"], r["s"], r["h"]) for r in good.orderBy("id").collect()] == [(1, 7, 72000, "07"), (3, None, None, None)]
    assert [(r["id"], r["reasons"], r["h"]) for r in bad.collect()] == [(2, ["bad_hour", "bad_clock"], "24")]
