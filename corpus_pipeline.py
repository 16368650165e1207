"""A training-corpus pipeline of five stages; each stage works on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shalegrid.llm import byte_bpe, decontam, quality_rules, secret_links, simhash_dedup
from shalegrid.llm.common import staged
from shalegrid.session import made, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the rules learn from the labelled ones among docs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id."""
    return simhash_dedup.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secret_links.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality rules", quality), ("near dedup", near_dedup), ("decontamination", decontaminate), ("secrets", secrets), ("byte-level BPE", tokenize)]

#: Fingerprints, trees and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' work on documents: doc_id, n_tokens, ids_sha256, decoded_sha256 of each row that all of them keep.

    Null texts are empty ones and fail the quality rules; so do empty ones. Rows that share an id, or have none, are told
    apart by their texts; of equal rows one stays. An empty table gives no rows. Columns besides doc_id and text pass
    through the stages unread (n_chars follows the text), whatever their names. What a stage has read is deleted once its
    result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mark = made()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "_"))
            release(spark, mark, keep=(docs._staged_path,))
    return docs
