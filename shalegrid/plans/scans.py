"""Scans, row groups, footers, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shalegrid.operators.schema import SchemaBuilder, leaves
from shalegrid.plans.base import GROUP, declaring, grouped_events, table
from shalegrid.sources.footers import footers
from shalegrid.sources.row_groups import scan_row_groups as read_groups
from shalegrid.sources.scan import merge, scan
from shalegrid.sources.scan import scan_bytes as decode_bytes

QUERIES, ORACLES, query = declaring()
ORDERS = "SELECT * FROM orders"


@query(ORDERS)
def scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/orders.parquet")


@query(ORDERS)
def scan_parallel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan: tasks read ranges of files side by side."""
    return scan(spark, f"{sf_dir}/orders.parquet")


@query(ORDERS)
def scan_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/orders.parquet"
    return decode_bytes(spark.read.format("binaryFile").load(path), spark.read.parquet(path).schema)


@query("SELECT l_shipdate FROM lineitem")
def scan_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, f"{sf_dir}/lineitem.parquet", ["l_shipdate"])


@query(f"SELECT * FROM events WHERE event_id // {GROUP} IN (0, 2, 5)")
def scan_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = grouped_events(spark, sf_dir)
    return read_groups(spark, path, [5, 0, 2], events.schema)


@query(f"SELECT event_id, user_id, CAST(0 AS BIGINT) AS place FROM events WHERE event_id // {GROUP} = 3 UNION ALL SELECT event_id, user_id, 1 FROM events WHERE event_id // {GROUP} = 1 UNION ALL SELECT event_id, user_id, 2 FROM events WHERE event_id // {GROUP} = 3")
def scan_row_groups_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = grouped_events(spark, sf_dir)
    return read_groups(spark, path, [3, 1, 3], events.schema, numbered=True).select("event_id", "user_id", "place")


@query(f"SELECT * FROM events WHERE event_id // {GROUP} = 4")
def scan_one_row_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, events = grouped_events(spark, sf_dir)
    return read_groups(spark, path, [4], events.schema)


@query("SELECT * FROM events")
def merge_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return merge([events.where(f"event_id div {GROUP} % 3 = {k}") for k in range(3)])


@query("SELECT 'orders.parquet' AS file, CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM orders")
def meta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footers(spark, f"{sf_dir}/orders.parquet").select("file", "n_rows", "n_columns")


@query(f"SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST((count(*) + {GROUP - 1}) // {GROUP} AS BIGINT) AS n_row_groups, CAST(6 AS BIGINT) AS n_columns FROM events")
def meta_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = grouped_events(spark, sf_dir)
    return footers(spark, path).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_row_groups").alias("n_row_groups"), F.max("n_columns").alias("n_columns"))


@query(f"SELECT n AS n_rows, CAST(count(*) AS BIGINT) AS n_groups FROM (SELECT event_id // {GROUP} AS g, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1) GROUP BY 1")
def meta_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = grouped_events(spark, sf_dir)
    return footers(spark, path, "row_group").groupBy("n_rows").agg(F.count("*").alias("n_groups"))


@query()
def meta_column_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = grouped_events(spark, sf_dir)
    return footers(spark, path, "column")


@query()
def meta_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = grouped_events(spark, sf_dir)
    pairs = footers(spark, path, "key_value").where("value is not null")
    return pairs.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("pairs"))


def fixture_schemas() -> dict[str, T.StructType]:
    pair = SchemaBuilder().column("a", "int", False).column("b", "string", False).build()
    return {
        "flat_struct": SchemaBuilder().column("name", "string").column("age", "int").build(),
        "tags": SchemaBuilder().array("tags", "string").build(),
        "id_tags": SchemaBuilder().column("id", "int").array("tags", "string").build(),
        "id_attrs": SchemaBuilder().column("id", "int").map("attrs", "string", "int").build(),
        "readme_nested": SchemaBuilder().column("name", "string").array("tags", "string").map("scores", "string", "int").build(),
        "nested_list": SchemaBuilder().array("m", T.ArrayType(T.IntegerType())).build(),
        "list_struct": SchemaBuilder().array("items", pair).build(),
        "group_struct": SchemaBuilder().group("g", pair).struct("s", pair).build(),
    }


LEAVES = [
    ("flat_struct", 0, "name", "string", 0, 0), ("flat_struct", 1, "age", "int", 0, 0), ("tags", 0, "tags.list.element", "string", 3, 1),
    ("id_tags", 0, "id", "int", 0, 0), ("id_tags", 1, "tags.list.element", "string", 3, 1),
    ("id_attrs", 0, "id", "int", 0, 0), ("id_attrs", 1, "attrs.key_value.key", "string", 2, 1), ("id_attrs", 2, "attrs.key_value.value", "int", 3, 1),
    ("readme_nested", 0, "name", "string", 0, 0), ("readme_nested", 1, "tags.list.element", "string", 3, 1),
    ("readme_nested", 2, "scores.key_value.key", "string", 2, 1), ("readme_nested", 3, "scores.key_value.value", "int", 3, 1),
    ("nested_list", 0, "m.list.element.list.element", "int", 5, 2), ("list_struct", 0, "items.list.element.a", "int", 4, 1), ("list_struct", 1, "items.list.element.b", "string", 4, 1),
    ("group_struct", 0, "g.a", "int", 1, 0), ("group_struct", 1, "g.b", "string", 1, 0), ("group_struct", 2, "s.a", "int", 2, 0), ("group_struct", 3, "s.b", "string", 2, 0),
]
_VALUES = ", ".join(f"('{a}', CAST({b} AS BIGINT), '{c}', '{d}', CAST({e} AS BIGINT), CAST({f} AS BIGINT))" for a, b, c, d, e, f in LEAVES)
_TABLE = f"(VALUES {_VALUES}) t(fixture, ord, path, kind, max_def, max_rep)"


def _leaf_rows(spark: SparkSession) -> DataFrame:
    rows = [(name, i, x.path, x.kind, x.max_def, x.max_rep) for name, s in fixture_schemas().items() for i, x in enumerate(leaves(s))]
    return spark.createDataFrame(rows, "fixture string, ord bigint, path string, kind string, max_def bigint, max_rep bigint")


@query(f"SELECT fixture, ord, path, kind FROM {_TABLE}")
def schema_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaf_rows(spark).select("fixture", "ord", "path", "kind")


@query(f"SELECT fixture, path, max_def, max_rep FROM {_TABLE}")
def schema_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaf_rows(spark).select("fixture", "path", "max_def", "max_rep")
