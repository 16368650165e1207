"""Shredding into levels and assembly from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalegrid.operators.nested import assemble_list as fold_list
from shalegrid.operators.nested import assemble_map as fold_map
from shalegrid.operators.nested import assemble_nested_list, assemble_value, shred
from shalegrid.operators.nested import assemble_struct as fold_struct
from shalegrid.plans.base import declaring, table

QUERIES, ORACLES, query = declaring()


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", "case when o_orderkey % 4 <> 0 then o_custkey end as cust")


@query("SELECT o_orderkey, CAST(0 AS BIGINT) AS rep, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS def, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS value FROM orders")
def shred_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(shred(_optional(spark, sf_dir), "o_orderkey", "cust"), "rep", "def")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS cust FROM orders")
def assemble_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_value(shred(_optional(spark, sf_dir), "o_orderkey", "cust"), "o_orderkey", "cust", 1)


def _structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = "case when o_orderkey % 3 <> 0 then struct(case when o_orderkey % 2 <> 0 then o_custkey end as cust, o_orderpriority as prio) end as s"
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", s)


@query("SELECT o_orderkey, CAST(0 AS BIGINT) AS rep, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS BIGINT) AS def, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 THEN o_custkey END AS value FROM orders")
def shred_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(shred(_structs(spark, sf_dir), "o_orderkey", "s.cust"), "rep", "def")


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AS none, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 THEN o_custkey END AS cust, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS prio FROM orders")
def assemble_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _structs(spark, sf_dir)
    made = fold_struct({f: shred(df, "o_orderkey", f"s.{f}") for f in ("cust", "prio")}, "o_orderkey", "s", 1)
    return made.select("o_orderkey", F.col("s").isNull().alias("none"), "s.cust", "s.prio")


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, CAST(CASE WHEN i > 1 THEN 1 ELSE 0 END AS BIGINT) AS rep, CAST(3 AS BIGINT) AS def, CAST(embedding[i] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def shred_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = shred(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding.list.element")
    return _longs(slots, "p1", "rep", "def").withColumnRenamed("p1", "pos").withColumn("value", F.col("value").cast("double"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[len(embedding)] AS DOUBLE) AS last, CAST(embedding[32] AS DOUBLE) AS middle FROM embeddings")
def assemble_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = shred(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding.list.element").repartition("value")
    back = fold_list(slots, "vec_id", "e")
    at = lambda i: F.element_at("e", i).cast("double")
    return back.select("vec_id", F.size("e").cast("long").alias("n"), at(1).alias("first"), at(-1).alias("last"), at(32).alias("middle"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = "case user_id % 3 when 0 then null when 1 then cast(array() as array<bigint>) else array(user_id, case when event_id % 2 = 0 then event_id end) end as e"
    return table(spark, sf_dir, "events").selectExpr("event_id", e)


_SLOTS = """SELECT event_id, CAST(NULL AS BIGINT) AS pos, CAST(0 AS BIGINT) AS rep, CAST(user_id % 3 AS BIGINT) AS def, CAST(NULL AS BIGINT) AS value FROM events WHERE user_id % 3 < 2
UNION ALL SELECT event_id, 0, 0, 3, user_id FROM events WHERE user_id % 3 = 2
UNION ALL SELECT event_id, 1, 1, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END, CASE WHEN event_id % 2 = 0 THEN event_id END FROM events WHERE user_id % 3 = 2"""


@query(_SLOTS)
def shred_list_null_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(shred(_lists(spark, sf_dir), "event_id", "e.list.element"), "p1", "rep", "def").withColumnRenamed("p1", "pos")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'null' WHEN user_id % 3 = 1 THEN '' ELSE user_id || ',' || CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE '-' END END AS e FROM events")
def assemble_list_null_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = fold_list(shred(_lists(spark, sf_dir), "event_id", "e.list.element").repartition("value"), "event_id", "e")
    return back.select("event_id", F.coalesce(F.array_join("e", ",", "-"), F.lit("null")).alias("e"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = """case event_id % 5 when 0 then null when 1 then cast(array() as array<array<bigint>>) when 2 then array(cast(null as array<bigint>))
    when 3 then array(cast(array() as array<bigint>)) else array(array(user_id, null), array(event_id)) end as m"""
    return table(spark, sf_dir, "events").selectExpr("event_id", m)


@query("""SELECT event_id, CAST(0 AS BIGINT) AS rep, CAST(event_id % 5 AS BIGINT) AS def, CAST(NULL AS BIGINT) AS value FROM events WHERE event_id % 5 < 4
UNION ALL SELECT event_id, 0, 5, user_id FROM events WHERE event_id % 5 = 4 UNION ALL SELECT event_id, 2, 4, NULL FROM events WHERE event_id % 5 = 4
UNION ALL SELECT event_id, 1, 5, event_id FROM events WHERE event_id % 5 = 4""")
def shred_nested_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(shred(_nested(spark, sf_dir), "event_id", "m.list.element.list.element"), "rep", "def").select("event_id", "rep", "def", "value")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '[]' WHEN 2 THEN '[null]' WHEN 3 THEN '[[]]' ELSE '[[' || user_id || ',null],[' || event_id || ']]' END AS m FROM events", "assemble_nested_list")
def assemble_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = shred(_nested(spark, sf_dir), "event_id", "m.list.element.list.element").repartition("value")
    back = assemble_nested_list(slots, "event_id", "m")
    return back.select("event_id", F.coalesce(F.to_json("m", {"ignoreNullFields": "false"}), F.lit("null")).alias("m"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = """case o_orderkey % 4 when 0 then null when 1 then cast(map() as map<string,string>)
    else map('status', o_orderstatus, 'priority', case when o_orderkey % 4 = 2 then o_orderpriority end) end as m"""
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey", m)


@query("""SELECT o_orderkey, CAST(NULL AS BIGINT) AS pos, CAST(0 AS BIGINT) AS rep, CAST(o_orderkey % 4 AS BIGINT) AS def, CAST(NULL AS VARCHAR) AS value FROM orders WHERE o_orderkey % 4 < 2
UNION ALL SELECT o_orderkey, 0, 0, 3, o_orderstatus FROM orders WHERE o_orderkey % 4 >= 2
UNION ALL SELECT o_orderkey, 1, 1, CASE WHEN o_orderkey % 4 = 2 THEN 3 ELSE 2 END, CASE WHEN o_orderkey % 4 = 2 THEN o_orderpriority END FROM orders WHERE o_orderkey % 4 >= 2""")
def shred_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _longs(shred(_maps(spark, sf_dir), "o_orderkey", "m.key_value.value"), "p1", "rep", "def").withColumnRenamed("p1", "pos")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0 ELSE 2 END::BIGINT AS n, CASE WHEN o_orderkey % 4 >= 2 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 4 = 2 THEN o_orderpriority END AS priority FROM orders")
def assemble_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _maps(spark, sf_dir)
    back = fold_map(shred(df, "o_orderkey", "m.key_value.key"), shred(df, "o_orderkey", "m.key_value.value"), "o_orderkey", "m")
    return back.select("o_orderkey", F.expr("cast(case when m is not null then size(m) end as bigint)").alias("n"), F.expr("m['status']").alias("status"), F.expr("m['priority']").alias("priority"))
