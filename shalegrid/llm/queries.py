"""The operators of this subpackage as queries over whole tables, with production parameters."""

from __future__ import annotations

import secrets

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shalegrid.llm import byte_bpe, decontam, html_extract, line_dedup, pii, quality_bayes, quality_rules, secret_links, simhash_dedup, token_counts
from shalegrid.llm.common import documents
from shalegrid.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(column: str, *names: str) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", *(s[n].cast("string") for n in names))), ",")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_repeats(documents(spark, sf_dir))
    return out.withColumn("removed", _spans("removed", "start", "end"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key in spark.shalegrid.pii.key; where it is unset, under a random one that nobody keeps, so that equal values
    are linked within the result only."""
    key = spark.conf.get("spark.shalegrid.pii.key", None)
    out = pii.pseudonymize(documents(spark, sf_dir), key.encode() if key else secrets.token_bytes(32))
    return out.withColumn("spans", _spans("spans", "kind", "start", "end"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(documents(spark, sf_dir))


def op8_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.digests(documents(spark, sf_dir))


def op9_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_bayes.classify(docs, quality_bayes.train(docs, _table(spark, sf_dir, "labels")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.score(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_html_main_text": op6_html_main_text,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_secret_links": op8_secret_links,
    "op9_quality_bayes": op9_quality_bayes,
    "op10_quality_rules": op10_quality_rules,
}
