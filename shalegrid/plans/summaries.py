"""Statistics, membership and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalegrid.functions import hashing
from shalegrid.operators import bloom
from shalegrid.operators.stats import chunk_stats, distinct_counts
from shalegrid.plans.base import CHUNK, declaring, table

QUERIES, ORACLES, query = declaring()


def _stats(columns: dict[str, str], key: str, source: str) -> str:
    parts = [x for c, e in columns.items() for x in (f"min({e}) AS min_{c}", f"max({e}) AS max_{c}", f"CAST(count(*) - count({e}) AS BIGINT) AS nulls_{c}")]
    return f"SELECT {key} // {CHUNK} AS rg, CAST(count(*) AS BIGINT) AS n, {', '.join(parts)} FROM {source} GROUP BY 1"


NUMBERS = ("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")


@query(_stats({c: c for c in NUMBERS}, "l_orderkey", "lineitem"))
def stats_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_stats(table(spark, sf_dir, "lineitem"), F.expr(f"l_orderkey div {CHUNK}"), [*NUMBERS])


@query(_stats({"o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus"}, "o_orderkey", "orders"))
def stats_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_stats(table(spark, sf_dir, "orders"), F.expr(f"o_orderkey div {CHUNK}"), ["o_orderpriority", "o_orderstatus"])


@query(f"SELECT event_id // {CHUNK} AS rg, CAST(count(*) AS BIGINT) AS n, CAST(count(*) - count(v) AS BIGINT) AS nulls, CAST(count(DISTINCT v) AS BIGINT) AS distinct_v FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS v FROM events) GROUP BY 1")
def stats_null_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr(f"event_id div {CHUNK} as g", "case when event_id % 7 <> 0 then user_id end as v")
    counted = chunk_stats(df, F.col("g"), ["v"]).select("rg", "n", F.col("nulls_v").alias("nulls"))
    return counted.join(distinct_counts(df, F.col("g"), ["v"]), "rg")


@query("SELECT event_type, n AS n_distinct, CAST((greatest(10 * n, 256) + 255) // 256 AS BIGINT) AS blocks, CAST(32 * ((greatest(10 * n, 256) + 255) // 256) AS BIGINT) AS bytes FROM (SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS n FROM events GROUP BY 1)")
def bloom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_distinct"))
    blocks = bloom.blocks_for(F.col("n_distinct"))
    return counts.select("event_type", "n_distinct", blocks.alias("blocks"), (blocks * 32).alias("bytes"))


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def bloom_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every tenth customer: the filter prunes the events, a semi-join makes the answer exact."""
    members = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey")
    blocks = bloom.blocks_for(members.count())
    maybe = bloom.might_contain(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", bloom.build(members, "c_custkey", blocks), blocks)
    return maybe.join(members, F.col("user_id") == F.col("c_custkey"), "left_semi")


@query()
def fn_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.crc32(F.col("c_name")).alias("crc"))


@query()
def fn_xxhash64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed 42 in generated code, seed 0 by Arrow batches; both of the name's UTF-8 bytes."""
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.xxhash64(F.col("c_name")).alias("seed42"), hashing.xxhash64_of_seed(F.col("c_name"), 0).alias("seed0"))
