"""The corpus pipeline: quality rules, MinHash near-dedup, PII redaction, mixing of sources, BPE encoding.

STAGES are (name, function) with functions of (spark, docs, sf_dir); run() writes what each stage keeps as Parquet into the
shared scratch folder, deletes what the stage itself left there, and gives the reread table to the next. All stages but the
last return the columns of documents, with any others that docs has, whatever their names, as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from markgrove.llm import bpe, minhash, mixing, pii, quality_rules
from markgrove.llm.common import Scratch, passing_scratch, read
from markgrove.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go.

    A null or empty text has too few words and goes; a text of any length is judged whole; equal rows are judged alike, and
    all of them stay or go; an empty table stays empty.
    """
    return quality_rules.kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of the least id stays.

    Rows of a null id, and texts without words, match nothing and stay; of rows with equal id and text one stays, different
    texts of one id are documents of their own; a text of any length is compared whole; an empty table stays empty.
    """
    return minhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; n_chars follows the new text.

    Every row stays; a null text stays null; a text of any length is masked whole; an empty table stays empty.
    """
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are copied so that all sources have equal weight, and globally shuffled.

    Rows of a null source are a source; rows of a null id are drawn by their text; repeated rows get the same number of copies
    each; texts of any length count whole; a document may get no copy; an empty table stays empty.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the ids of each text, which have been decoded and held against it.

    A null or empty text has no ids; a text of any length is encoded whole; every row stays; an empty table stays empty.
    """
    return bpe.encoded(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("minhash_dedup", near_dedup), ("pii", redact), ("mix", mix), ("bpe", encode)]

#: Suffix arrays, signatures and merge queues are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with passing_scratch():
            done = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(docs)
        docs = done
    return docs
