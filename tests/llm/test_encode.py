import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import encode as E
from weftline.llm import tokens
from weftline.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def plain(tokenizer, texts):
    return [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = [
    None, "", " ", "\n\n", "a", "<|endoftext|> x", "it's they'll WE'RE", "  two  spaces \t tab nbsp", "naïve café 中文字符 русский ١٢٣ 12³½", "🙂👩‍👩‍👧 é",
    "x" * 200_000, "word " * 30_000, "  \u0085　 ﻿", "a\r\nb\rc\n", "''s 's'", "\x00\x01\x1f", " " * 5000 + "end", "9" * 3000, "\U0001f600" * 2000,
]


def ids(df):
    return {r["doc_id"]: list(r["ids"]) for r in df.collect()}


def test_odd_texts_and_decoding(spark, tokenizer):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    got = ids(E.encode_corpus(df))
    assert [got[i] for i in range(len(ODD))] == plain(tokenizer, ODD)
    back = {r["doc_id"]: r["text"] for r in E.decode_corpus(E.encode_corpus(df)).collect()}
    assert [back[i] for i in range(len(ODD))] == [t or "" for t in ODD]


def test_random_texts_over_small_blocks(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(E, "BLOCK_CHARS", 300)
    rng = random.Random(4)
    alphabet = list("ab  \n\t.,'s1é中🙂 ")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(600)]
    got = ids(E.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)))
    assert [got[i] for i in range(len(texts))] == plain(tokenizer, texts)


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, len(r["ids"])) for r in E.encode_corpus(df).collect()) == [(-1, 1), (1, 2), (1, 2)]
    assert E.encode_corpus(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [-1, 99999999, 64])], "doc_id long, ids array<int>")
    assert [r["text"] for r in E.decode_corpus(odd).orderBy("doc_id").collect()] == [None, "", "a"]


def test_whole_table(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = ids(QUERIES["p7_ids"](spark, small))
    assert [got[d["doc_id"]] for d in docs] == plain(tokenizer, [d["text"] for d in docs])
    back = {r["doc_id"]: r["text"] for r in QUERIES["p7_decoded"](spark, small).collect()}
    assert back == {d["doc_id"]: d["text"] or "" for d in docs}


def test_two_shuffles(spark, small):
    plan = QUERIES["p7_ids"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and "SortMergeJoin" not in plan


def test_packed_numbers():
    rng = random.Random(1)
    for _ in range(200):
        rows = [sorted(rng.sample(range(rng.choice([5, 300, 2**31])), rng.randrange(1, 5))) for _ in range(rng.randrange(0, 6))]
        counts = np.array([len(r) for r in rows], np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
        flat = np.array([x for r in rows for x in r], np.int64)
        data, ends = E.packed(flat, starts)
        assert E.unpacked(data, counts).tolist() == flat.tolist() and ends[-1] == len(data)


def test_each_distinct_word_is_encoded_once(spark, tmp_path):
    """However many blocks it is in: counted in the workers, by a line a call."""
    seen = str(tmp_path / "calls")
    inner = E.encoding

    def counted(folder, vocabulary):
        class Core:
            def encode_single_piece(self, word):
                with open(seen, "ab") as out:
                    out.write(word.hex().encode() + b"\n")
                return inner(folder, vocabulary)._core_bpe.encode_single_piece(word)

        return type("Encoding", (), {"_core_bpe": Core()})

    texts = ["the same words " * 50 + f"and {i % 7}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    before = E.encoding, E.BLOCK_CHARS
    E.encoding, E.BLOCK_CHARS = counted, 2000
    try:
        n = sum(len(r["ids"]) for r in E.encode_corpus(df).collect())
    finally:
        E.encoding, E.BLOCK_CHARS = before
    calls = open(seen).read().split()
    assert n > 60_000 and len(calls) == len(set(calls)) == 5 + 7  # the, " the", " same", " words", " and", and seven numbers
