"""Writes and what is read back."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalegrid.plans.base import GROUP, declaring, grouped_events, table, written
from shalegrid.session import workspace
from shalegrid.sources.row_groups import scan_row_groups as read_groups
from shalegrid.sources.sink import GZIP, SNAPPY, ZSTD, WriteOptions
from shalegrid.streaming.sink import append_stream

QUERIES, ORACLES, query = declaring()

ROUNDTRIPS = {
    "uncompressed": WriteOptions(), "snappy": SNAPPY, "gzip": GZIP, "zstd": ZSTD, "lz4_raw": WriteOptions("lz4_raw", dictionary=True),
    "v1": WriteOptions("snappy", page_version=1), "v2": WriteOptions("snappy", page_version=2), "dictionary": WriteOptions(dictionary=True),
    "nostats": WriteOptions(statistics=False), "bloom": WriteOptions(bloom=(("o_custkey", 10_000),)),
}


def _roundtrip(options: WriteOptions, spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(table(spark, sf_dir, "orders"), "orders", options)


for _name, _options in ROUNDTRIPS.items():
    query("SELECT * FROM orders", f"write_roundtrip_{_name}")(partial(_roundtrip, _options))


@query(f"SELECT event_id // {GROUP} AS row_group, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def write_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = grouped_events(spark, sf_dir)
    back = read_groups(spark, path, None, events.select("event_id").schema, numbered=True)
    return back.groupBy("row_group").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def write_nested_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = written(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "lists")
    return back.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


@query("SELECT o_orderkey, 'priority' AS key, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS value FROM orders UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders")
def write_nested_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.expr("case when o_orderkey % 7 <> 0 then o_orderpriority end"))
    back = written(table(spark, sf_dir, "orders").select("o_orderkey", pairs.alias("pairs")), "maps")
    return back.select("o_orderkey", F.explode("pairs").alias("key", "value"))


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS none, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS cust, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price FROM orders")
def write_nested_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.when(F.col("o_orderkey") % 5 != 0, F.struct(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("price")))
    back = written(table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s")), "structs")
    return back.select("o_orderkey", F.col("s").isNull().alias("none"), "s.cust", "s.price")


@query("SELECT * FROM events")
def stream_write_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)
    path = workspace(spark, "stream")
    append_stream(stream, path, workspace(spark, "progress"), SNAPPY).awaitTermination()
    return spark.read.schema(schema).parquet(path)
