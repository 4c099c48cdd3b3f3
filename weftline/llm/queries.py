"""Queries of problems 7 to 9. None has SQL: tests/llm compares them with plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.cutting import oversized
from weftline.llm.encode import decode_corpus, encode_corpus
from weftline.llm.mixing import mix_sources, shares
from weftline.sources.tables import table


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encode_corpus(table(spark, directory, "documents"))


def p7_decoded(spark: SparkSession, directory: str) -> DataFrame:
    """The texts back from their ids; a null text comes back empty."""
    return decode_corpus(p7_ids(spark, directory))


def _mix(spark: SparkSession, directory: str, **how: bool) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, directory, "documents"), table(spark, directory, "mix_targets"), **how)


def p8_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The documents of the mix and how often each is used."""
    return _mix(spark, directory)[0]


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The share that each source was to have, and the one it has."""
    return shares(*_mix(spark, directory))


def p8_whole_mix(spark: SparkSession, directory: str) -> DataFrame:
    """A mix of as many tokens as the sources with a target have, its shares as near the targets as repeats allow."""
    return _mix(spark, directory, whole=True)[0]


def p8_whole_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The shares of p8_whole_mix, and which targets it misses."""
    return shares(*_mix(spark, directory, whole=True))


def p8_entropy_mix(spark: SparkSession, directory: str) -> DataFrame:
    """A mix of the same size whose shares are the corpus' own, flattened or sharpened to the entropy of the targets."""
    return _mix(spark, directory, by_entropy=True)[0]


def p8_entropy_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The shares of p8_entropy_mix."""
    return shares(*_mix(spark, directory, by_entropy=True))


def p9_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of all documents of more than 1,024 tokens."""
    return oversized(table(spark, directory, "documents"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """Documents that had to be cut: those with a second piece."""
    return p9_pieces(spark, directory).filter(F.col("piece_no") == 1).select("doc_id")


QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_whole_mix": p8_whole_mix, "p8_whole_shares": p8_whole_shares, "p8_entropy_mix": p8_entropy_mix, "p8_entropy_shares": p8_entropy_shares, "p9_found": p9_found, "p9_pieces": p9_pieces}
SQL: dict[str, str] = {}
