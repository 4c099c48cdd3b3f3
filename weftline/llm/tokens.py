"""The public tokenizer: its files, and what of it runs in Python workers."""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Callable

#: Folder of the vocabulary files; a parameter of every operator, this being its default.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _kept(key: tuple, make: Callable):
    """Made once per process. These functions travel to the workers by value, so what they keep hangs on a module that stays."""
    store = sys.__dict__.setdefault("_weftline_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]


def ranks(folder: str, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    def make() -> dict[bytes, int]:
        with open(os.path.join(folder, vocabulary), "rb") as lines:
            return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}

    return _kept(("ranks", folder, vocabulary), make)


def encoding(folder: str, vocabulary: str = VOCABULARY):
    """Without special tokens: their strings are ordinary text."""
    import tiktoken

    return _kept(("encoding", folder, vocabulary), lambda: tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks(folder, vocabulary), special_tokens={}))


def token_bytes(folder: str, vocabulary: str = VOCABULARY) -> list[bytes]:
    """Bytes by id."""

    def make() -> list[bytes]:
        table = ranks(folder, vocabulary)
        out = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            out[rank] = token
        return out

    return _kept(("bytes", folder, vocabulary), make)
