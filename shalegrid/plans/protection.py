"""Encryption of values and files."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shalegrid.functions.crypto import decrypt, encrypt, module_aad, try_decrypt
from shalegrid.plans.base import declaring, table
from shalegrid.session import workspace
from shalegrid.sources.encrypted import read_encrypted, write_encrypted

QUERIES, ORACLES, query = declaring()
#: Keys for the test tables only.
KEY, OTHER = b"0123456789abcdef", b"fedcba9876543210"
KEYS = {"footer": KEY, "price": OTHER}


@query("SELECT c_custkey, c_name, CAST(strlen(c_name) + 28 AS BIGINT) AS sealed_bytes FROM customer")
def aes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = table(spark, sf_dir, "customer").select("c_custkey", encrypt(F.col("c_name"), KEY).alias("sealed"))
    return sealed.select("c_custkey", decrypt(F.col("sealed"), KEY).cast("string").alias("c_name"), F.octet_length("sealed").cast("long").alias("sealed_bytes"))


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer")
def aes_wrong_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    sealed = table(spark, sf_dir, "customer").select("c_custkey", encrypt(F.col("c_name"), KEY).alias("sealed"))
    return sealed.select("c_custkey", try_decrypt(F.col("sealed"), OTHER).cast("string").alias("c_name"))


@query("SELECT c_custkey, c_name AS same_page, CAST(NULL AS VARCHAR) AS other_page FROM customer")
def aes_aad_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    here, there = module_aad("data_page", 0, 1, 2), module_aad("data_page", 0, 1, 3)
    sealed = table(spark, sf_dir, "customer").select("c_custkey", encrypt(F.col("c_name"), KEY, here).alias("sealed"))
    return sealed.select("c_custkey", *(try_decrypt(F.col("sealed"), KEY, aad).cast("string").alias(n) for n, aad in (("same_page", here), ("other_page", there))))


def _sealed_orders(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = workspace(spark, "sealed")
    write_encrypted(orders, path, KEYS, "footer", {"price": ["o_totalprice"]})
    return path, orders


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def encrypted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, orders = _sealed_orders(spark, sf_dir)
    return read_encrypted(spark, path, KEYS, orders.schema)


@query()
def encrypted_no_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reads of the encrypted orders fail: with all keys, without the column's, with a wrong footer key."""
    path, orders = _sealed_orders(spark, sf_dir)
    rows = []
    for name, keys in (("all", KEYS), ("footer only", {"footer": KEY}), ("wrong footer", {"footer": OTHER, "price": OTHER})):
        try:
            rows.append((name, read_encrypted(spark, path, keys, orders.schema).agg(F.count("o_totalprice")).first()[0]))
        except PySparkException:
            rows.append((name, None))
    return spark.createDataFrame(rows, "keys string, n bigint")
