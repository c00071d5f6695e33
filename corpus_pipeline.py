"""A training corpus from ``documents`` in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, exact_dedup, jaccard, language_id, mixing
from quern.llm.common import staged
from quern.llm.queries import PATTERN, RANKS

#: SQL can't express compression, sketches or byte pairs; tests compare run() with a brute-force version.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that compression can tell go: null, empty, without a letter, or with a margin under that
    of all labelled rows. Each row is told by itself, a long text as a whole; repeated rows have one fate."""
    return language_id.accepted(docs, language_id.dictionaries(docs), fit="lang")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays (null ids last, one of repeated rows); null is the empty text."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8, directly or by others, that with the smallest id stays
    (null ids last); texts without words link to nothing."""
    return jaccard.keep(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat so that their sources come to their target weights; a null source is one of its own, empty texts have size 0."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole texts as tokens: their number, the digest of the ids and that of the bytes decoded again; null is the empty text."""
    return bpe.digest(docs, RANKS, PATTERN)


STAGES = [("language ID", identify_language), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("source mixing", mix_sources), ("byte-level BPE", encode_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, one after another; other columns, whatever their names, come along up to the last. An
    empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
