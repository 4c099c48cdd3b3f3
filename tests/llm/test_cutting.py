import random

import numpy as np
import pytest

from weftline.llm import cutting as C
from weftline.llm import tokens
from weftline.llm.queries import QUERIES


def pieces(spark, texts, limit, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in C.cut_texts(df, limit, overlap).orderBy("doc_id", "piece_no").collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def check(texts, got, limit, overlap):
    encode = tokens.encoding(tokens.TOKENIZERS).encode_ordinary
    for i, text in enumerate(texts):
        ids, own = encode(text or ""), got[i]
        assert [p["piece_no"] for p in own] == list(range(len(own)))
        assert (len(own) > 1) == (len(ids) > limit)
        joined = list(own[0]["ids"])
        for a, b in zip(own, own[1:]):
            assert overlap == 0 or list(b["ids"])[:overlap] == list(a["ids"])[-overlap:]
            assert b["start_token"] == a["end_token"] - overlap and b["end_token"] > a["end_token"]
            joined += list(b["ids"])[overlap:]
        assert joined == ids and all(len(p["ids"]) <= limit and p["doc_tokens"] == len(ids) for p in own)


ODD = [None, "", "short", "x" * 30_000, "no break" * 4000, "🙂" * 3000, "中文字符没有空格" * 500, "a " * 3000, "One. Two! Three? " * 400, "line one\nline two\n" * 300, "para\n\npara two.\r\n\r\n" * 300, " " * 9000, "é" * 5000, "1" * 9000 + "\n\n" + "2" * 9000]


@pytest.mark.parametrize(("limit", "overlap"), [(1024, 64), (64, 16), (10, 0), (3, 2)])
def test_whole_and_overlapping(spark, limit, overlap):
    check(ODD, pieces(spark, ODD, limit, overlap), limit, overlap)


def test_natural_boundaries(spark):
    got = pieces(spark, ["alpha beta gamma.\n\n" * 100, "alpha beta gamma.\n" * 100, "Alpha beta gamma. " * 100, "alpha beta " * 300, "x" * 9000], 64, 8)
    assert [{p["cut"] for p in got[i][:-1]} for i in range(5)] == [{"paragraph"}, {"line"}, {"sentence"}, {"word"}, {"hard"}]
    assert all(p["text"].endswith("gamma.\n\n") for p in got[0][:-1])
    assert all(p["text"].endswith("gamma.") for p in got[2][:-1])


def test_random_boundaries_against_a_plain_search():
    rng = random.Random(6)
    for _ in range(300):
        n, limit = rng.randrange(1, 200), rng.randrange(2, 40)
        overlap = rng.randrange(0, limit)
        kinds = [np.array(sorted(rng.sample(range(n), min(n, rng.randrange(0, 12))))) for _ in range(4)]
        whole = np.array(sorted(rng.sample(range(n), n - n // 5)))
        got = C.cuts(n, limit, overlap, kinds, whole)
        assert got[0][0] == 0 and got[-1][1] == n
        for (a, b, name), (c, _, _) in zip(got, got[1:]):
            assert c == b - overlap and b > a + overlap and b - a <= limit
            late = max(a + overlap + 1, a + int(limit * C.LATE_SHARE))
            want = next((max(x for x in k if low <= x <= a + limit) for k, low in [*((k, late) for k in kinds[:3]), (kinds[3], a + overlap + 1), (whole, a + overlap + 1)] if any(low <= x <= a + limit for x in k)), a + limit)
            assert b == want, name


def test_bad_overlap_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    with pytest.raises(ValueError):
        C.cut_texts(df, 10, 10)
    assert C.cut_texts(df).count() == 2 and C.cut_texts(df.limit(0)).count() == 0 and C.oversized(df).count() == 0


def test_found(spark, small):
    encode = tokens.encoding(tokens.TOKENIZERS).encode_ordinary
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = sorted(d["doc_id"] for d in docs if len(encode(d["text"] or "")) > 1024)
    assert sorted(r["doc_id"] for r in QUERIES["p9_found"](spark, small).collect()) == want
    assert QUERIES["p9_pieces"](spark, small).select("doc_id").distinct().count() == len(want)
