"""Texts cut into pieces of a limited number of tokens, at natural boundaries, with an overlap (problem 9)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZERS, VOCABULARY, encoding, token_bytes

# What ends a paragraph, a line, a sentence and a word; the cut comes after the match.
BOUNDARIES = (
    r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)+",
    r"(?:\r\n|\r|\n)",
    r"[.!?…]+[\"'”’)\]]*(?=\s)|[。！？]+[”’」』）]*",
    r"(?=\s)",
)
#: The first kind of boundary is taken that has one in the last part of this share of a piece, or of the whole for words.
LATE_SHARE = 0.5


def boundary_tokens(data: bytes, starts: np.ndarray, patterns: tuple) -> list[np.ndarray]:
    """Per kind of boundary, in order: the sorted indexes of tokens that begin at or first after such a boundary.

    starts: byte offset of each token, a prefix sum of the tokens' lengths. A boundary within a token doesn't count.
    """
    text = data.decode("utf-8")
    plain = len(text) == len(data)
    at_byte = None if plain else np.concatenate([[0], np.cumsum([len(c.encode()) for c in text])])
    kinds = []
    for pattern in patterns:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        ends = ends if plain or not len(ends) else at_byte[ends]
        at = np.searchsorted(starts, ends)
        exact = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] == ends)
        kinds.append(np.unique(at[exact]))
    return kinds


def cuts(n: int, limit: int, overlap: int, kinds: list[np.ndarray], whole: np.ndarray) -> list[tuple[int, int, str]]:
    """Pieces (start, end, kind of cut) of n tokens, each but the first starting ``overlap`` before the last one's end.

    By binary search, the last boundary within the limit of the first kind that has one late enough; failing all, the last
    token that begins a character (``hard``), and failing that too, the limit itself.
    """
    names = ("paragraph", "line", "sentence", "word", "hard")
    lists = [k.tolist() for k in kinds] + [whole.tolist()]
    pieces, start = [], 0
    while n - start > limit:
        least, most = start + overlap + 1, start + limit
        late = max(least, start + int(limit * LATE_SHARE))
        end, name = most, "hard"
        for kind, found in zip(names, lists):
            i = bisect_right(found, most) - 1
            if i >= 0 and found[i] >= (late if kind in names[:3] else least):
                end, name = found[i], kind
                break
        pieces.append((start, end, name))
        start = end - overlap
    return [*pieces, (start, n, "end")]


def _cutter(limit: int, overlap: int, folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encode, table = encoding(folder, vocabulary).encode_ordinary, token_bytes(folder, vocabulary)
        lengths = np.array([len(b) for b in table])
        patterns = tuple(regex.compile(p) for p in BOUNDARIES)
        kind_names = ["doc_id", "piece_no", "start_token", "end_token", "doc_tokens", "cut", "ids", "text"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.array(encode(text or ""), np.int32)
                if len(ids) > limit:
                    data = text.encode()
                    ends = np.cumsum(lengths[ids])
                    starts = np.concatenate([[0], ends[:-1]])
                    raw = np.frombuffer(data, np.uint8)
                    whole = np.flatnonzero((raw[starts] & 0xC0) != 0x80)
                    pieces = cuts(len(ids), limit, overlap, boundary_tokens(data, starts, patterns), whole)
                    rows += [(doc, k, a, b, len(ids), name, ids[a:b], data[starts[a] : ends[b - 1]].decode("utf-8", "replace")) for k, (a, b, name) in enumerate(pieces)]
                else:
                    rows.append((doc, 0, 0, len(ids), len(ids), "end", ids, text or ""))
                size += len(rows[-1][6]) + len(text or "")
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=kind_names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=kind_names)

    return run


def cut_texts(df: DataFrame, limit: int = 1024, overlap: int = 64, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of every text of (doc_id, text), in order, without a shuffle.

    Columns: doc_id, piece_no (from 0), start_token, end_token, doc_tokens, cut (what the piece ends at: ``paragraph``,
    ``line``, ``sentence``, ``word``, ``hard``, or ``end`` of the text), ids, text. A piece has at most ``limit`` tokens of
    the text's own encoding, and each after the first begins with the last ``overlap`` of the one before; so the ids
    without the overlaps are the text's ids. Where a piece begins or ends within a character, its text shows U+FFFD there.
    A text within the limit is one piece; null and empty texts are one piece without tokens. Repeated rows are cut each by
    itself, other columns are left out, an empty table gives an empty one.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    slim = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, piece_no int, start_token int, end_token int, doc_tokens int, cut string, ids array<int>, text string"
    return slim.mapInArrow(_cutter(limit, overlap, folder, vocabulary), schema)


def oversized(df: DataFrame, limit: int = 1024, overlap: int = 64, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of the texts beyond the limit alone. A token has a byte at least, so shorter texts needn't be encoded."""
    return cut_texts(df.filter(F.octet_length("text") > limit), limit, overlap, folder, vocabulary).filter(F.col("doc_tokens") > limit)
