"""The queries of this subpackage, opN_<name>: each applies its operator to its whole table. SQL has the equal DuckDB text where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, classifier, embedding_dedup, lm_scoring, minhash, mixing, pii, quality_rules, warc
from .common import read


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents so that all sources have equal weight, one epoch in all, globally shuffled."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_dedup.classes(read(spark, sf_dir, "embeddings"))


def op3_suffix_array_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge(read(spark, sf_dir, "documents")).drop("longest_repeat")


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.digest(read(spark, sf_dir, "documents"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document under the counts of all others."""
    return lm_scoring.score(read(spark, sf_dir, "documents"))


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and selection of every document; trained on labels."""
    return classifier.select(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.classes(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document's whole text."""
    return bpe.round_trip(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exchange of all conversations, linked, ordered, validated and serialised."""
    return chat.format_conversations(read(spark, sf_dir, "conversations"), variants=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_poisson_mix, op2_hnsw_dedup, op3_suffix_array_rules, op4_pii_anchors, op5_stupid_backoff, op6_warc_segments, op7_ordinal_quality, op8_bagminhash, op9_bpe, op10_tool_calls)
}


SQL: dict[str, str] = {"op1_poisson_mix": mixing.SQL, "op2_hnsw_dedup": embedding_dedup.SQL, "op3_suffix_array_rules": quality_rules.SQL, "op5_stupid_backoff": lm_scoring.SQL, "op6_warc_segments": warc.SQL, "op8_bagminhash": minhash.SQL, "op10_tool_calls": chat.SQL}
