"""Split-block Bloom filter as a grouped bit-or and a probing join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The eight salts of the split-block filter; fixed values of the file format.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
BITS_EACH, BLOCK_BITS = 10, 256


def blocks_for(distinct):
    """Blocks of 256 bits at ten bits for each distinct value; one at least. For a number or a column."""
    if isinstance(distinct, Column):
        return F.ceil(F.greatest(distinct * BITS_EACH, F.lit(BLOCK_BITS)) / BLOCK_BITS).cast("long")
    return -(-max(distinct * BITS_EACH, BLOCK_BITS) // BLOCK_BITS)


def _places(value: Column, blocks: int) -> Column:
    """array<struct<block, word, bit>>: the eight bits of a value."""
    h = F.xxhash64(value)
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)

    def bit(salt: int) -> Column:  # (high * salt mod 2^32) >> 27, in halves that a long holds
        upper = F.shiftleft((high * F.lit(salt >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
        return F.shiftright((upper + high * F.lit(salt & 0xFFFF)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int")

    return F.array(*(F.struct((low % blocks).alias("block"), F.lit(i).alias("word"), bit(s).alias("bit")) for i, s in enumerate(SALTS)))


def build(df: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, word, bits): the filter of the values that are not null."""
    places = df.where(F.col(column).isNotNull()).select(F.explode(_places(F.col(column), blocks)).alias("x")).select("x.*")
    return places.groupBy("block", "word").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits"))


def might_contain(df: DataFrame, column: str, filter_bits: DataFrame, blocks: int) -> DataFrame:
    """The rows of df whose value may be among those of the filter: none that is, is lost; nulls are not."""
    words = filter_bits.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__words"))
    probe = df.where(F.col(column).isNotNull()).withColumn("__places", _places(F.col(column), blocks)).withColumn("__block", F.col("__places")[0]["block"])
    both = probe.join(words.withColumnRenamed("block", "__b"), F.col("__block") == F.col("__b"))
    hit = F.forall("__places", lambda p: F.coalesce(F.expr("__words")[p["word"]], F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1), p["bit"])) != 0)
    return both.where(hit).select(*df.columns)
