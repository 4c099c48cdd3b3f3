"""Encoding of a whole corpus: each distinct word is encoded once (problem 7).

Texts are cut into words by the tokenizer's pattern, in blocks of documents. A block sends each of its distinct words once,
with all its positions, to the partition of that word's bucket; there every word is encoded once, and its ids go back to the
block, which puts them in order. All words of a block and bucket travel as one row of packed bytes, so the shuffles move few
rows whatever the number of words; a word has at most one place a block, so no word is hot, and a block is bounded in
characters (one document beyond that is a block by itself).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import PATTERN, TOKENIZERS, VOCABULARY, encoding, token_bytes

#: Characters of a block, but for its last document.
BLOCK_CHARS = 2_000_000
#: Buckets of words for each partition of the shuffle. A partition takes its buckets one after the other and forgets the words
#: of the last, so it holds a part of its distinct words at a time, each encoded once.
BUCKETS = 4


def packed(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, ascending from each of ``starts`` to the next, as differences in as few bytes of 7 bits as do; and the bounds of
    each number's bytes."""
    steps = values.astype(np.int64)
    steps[1:] -= values[:-1]
    steps[starts] = values[starts]
    size = 1 + sum((steps >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for k in range(5):
        more = size > k
        out[ends[:-1][more] + k] = (steps[more] >> 7 * k & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, ends


def unpacked(data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of packed(); counts: how many there are from each start to the next."""
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.empty(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    within = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    total = np.concatenate([[0], np.cumsum(np.add.reduceat((data & 127).astype(np.int64) << 7 * within, starts))])
    firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return total[1:] - np.repeat(total[firsts], counts)


def _blobs(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of an array of any numbers as binaries; bounds count numbers."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _numbers(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of binaries without nulls, and the rows' bounds in them."""
    rows = [np.frombuffer(b, kind) for b in column.to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    return np.concatenate([np.empty(0, kind), *rows]), bounds


#: block; bucket; bytes of its words one after the other, their lengths, how often each occurs, where; and in one row of the block
#: its documents' ids and numbers of words.
_SENT = "block bigint, bucket int, words binary, lengths binary, counts binary, positions binary, docs array<bigint>, n_words array<int>"
_BACK = "block bigint, ids binary, sizes binary, counts binary, positions binary, docs array<bigint>, n_words array<int>"


def _cutter(buckets: int):
    def closed(block: int, docs: list, counts: list[int], words: list[str]) -> pa.RecordBatch:
        coded = pa.array(words, pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        own = [w.encode() for w in coded.dictionary.to_pylist()]
        bucket = np.array([crc32(w) % buckets for w in own], np.int32)
        order = np.argsort(bucket, kind="stable")  # the words by bucket
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        places = np.argsort(rank[codes], kind="stable") if len(codes) else np.empty(0, np.int64)
        often = np.bincount(rank[codes], minlength=len(own)) if len(codes) else np.empty(0, np.int64)
        bounds = np.concatenate([[0], np.cumsum(often)]).astype(np.int64)
        found, firsts = np.unique(bucket[order], return_index=True)
        rows = np.append(firsts, len(own))  # words by row
        data, ends = packed(places, bounds[:-1])
        lengths = np.array([len(own[i]) for i in order], np.int32)
        letters = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        text = np.frombuffer(b"".join(own[i] for i in order), np.uint8)
        n = len(found)
        # The documents' own row has no words; it goes anywhere.
        columns = [
            pa.array(np.full(n + 1, block)), pa.array([block % buckets, *found.tolist()], pa.int32()),
            *(pa.concat_arrays([pa.array([b""]), c]) for c in (_blobs(text, letters[rows]), _blobs(lengths, rows), _blobs(often.astype(np.int32), rows), _blobs(data, ends[bounds[rows]]))),
            pa.array([docs, *[None] * n], pa.list_(pa.int64())), pa.array([counts, *[None] * n], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "words", "lengths", "counts", "positions", "docs", "n_words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of documents, cut into words."""
        import regex

        split = regex.compile(PATTERN).findall
        part, number = TaskContext.get().partitionId(), 0
        docs, counts, words, chars = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                found = split(text) if text else []
                docs.append(doc)
                counts.append(len(found))
                words += found
                chars += len(text or "")
                if chars >= BLOCK_CHARS or len(docs) >= 100_000:
                    yield closed(part * 2**31 + number, docs, counts, words)
                    docs, counts, words, chars, number = [], [], [], 0, number + 1
        if docs:
            yield closed(part * 2**31 + number, docs, counts, words)

    return run


def _encoder(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in the order of buckets; each distinct word of a bucket is encoded once."""
        piece, kept, at = encoding(folder, vocabulary)._core_bpe.encode_single_piece, {}, None
        for batch in batches:
            ids, sizes = [], []
            for bucket, text, lengths in zip(batch["bucket"].to_pylist(), batch["words"].to_pylist(), batch["lengths"].to_pylist()):
                if bucket != at:
                    kept, at = {}, bucket
                got, start = [], 0
                for n in np.frombuffer(lengths, np.int32).tolist():
                    word = text[start : start + n]
                    start += n
                    one = kept.get(word)
                    if one is None:
                        one = kept[word] = np.array(piece(word), np.int32).tobytes()
                    got.append(one)
                ids.append(b"".join(got))
                sizes.append(np.array([len(g) // 4 for g in got], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch["block"], pa.array(ids, pa.binary()), pa.array(sizes, pa.binary()), *(batch[c] for c in ("counts", "positions", "docs", "n_words"))], names=["block", "ids", "sizes", "counts", "positions", "docs", "n_words"])

    return run


def _reassembled(block: pa.Table) -> pa.Table:
    """The documents of one block: at every position stand the ids of its word."""
    head = pc.indices_nonzero(pc.is_valid(block["docs"]))[0].as_py()
    docs, n_words = (block[c].combine_chunks()[head].values for c in ("docs", "n_words"))
    flat, _ = _numbers(block["ids"], np.int32)
    sizes, _ = _numbers(block["sizes"], np.int32)
    counts, _ = _numbers(block["counts"], np.int32)
    data, _ = _numbers(block["positions"], np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
    positions = unpacked(data, counts)
    word_at = np.empty(len(positions), np.int64)
    word_at[positions] = np.repeat(np.arange(len(counts)), counts)
    size_at = sizes[word_at].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(size_at)])
    taken = np.repeat(starts[word_at] - ends[:-1], size_at) + np.arange(ends[-1])
    of_docs = ends[np.concatenate([[0], np.cumsum(n_words.to_numpy())])].astype(np.int32)
    return pa.table({"doc_id": docs, "ids": pa.ListArray.from_arrays(pa.array(of_docs), pa.array(flat[taken.astype(np.int64)]))})


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id bigint, ids array<int>: the whole text's ids without special tokens; one row per row of the input.

    Null and empty texts get an empty array. Strings of special tokens are ordinary text. Repeated rows and ids are encoded
    each by itself, null ids stay null, other columns are left out, an empty table gives an empty one. Words are spread over
    BUCKETS times as many buckets as spark.sql.shuffle.partitions says.
    """
    slim = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    buckets = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = slim.mapInArrow(_cutter(buckets), _SENT)
    routed = blocks.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    encoded = routed.mapInArrow(_encoder(folder, vocabulary), _BACK)
    return encoded.groupBy("block").applyInArrow(_reassembled, "doc_id bigint, ids array<int>")


def _decoder(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(token_bytes(folder, vocabulary), pa.binary())
        for batch in batches:
            ids = batch["ids"]
            known = pc.and_(pc.greater_equal(ids.flatten(), 0), pc.less(ids.flatten(), len(table)))
            values = table.take(pc.if_else(known, ids.flatten(), None))
            values = pc.fill_null(values, b"")
            lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values), b"")
            texts = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pc.if_else(pc.is_valid(ids), texts, None)], names=["doc_id", "text"])

    return run


def decode_corpus(df: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of (doc_id, ids), each id joined with the table of token bytes, whose size the vocabulary fixes.

    Ids out of the vocabulary give no bytes, null arrays a null text, empty ones an empty text.
    """
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoder(folder, vocabulary), "doc_id bigint, text string")
