"""Column encodings as windows and aggregates, and their inverses.

Every encoding's state lives in one column chunk, so every window and group is by `rg`, the row group; `pos` gives the
order in it. Inputs have the columns rg, pos and value.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalegrid.functions.bits import bit_width

BLOCK, MINIBLOCK = 128, 32


def _in_chunk(order: str = "pos"):
    return Window.partitionBy("rg").orderBy(order)


def chunked(df: DataFrame, pos: str, value, rows: int) -> DataFrame:
    """(rg, pos, value): chunks of so many places."""
    return df.select(F.expr(f"cast({pos} div {rows} as bigint)").alias("rg"), F.col(pos).cast("long").alias("pos"), value.alias("value"))


def boolean_bytes(df: DataFrame) -> DataFrame:
    """(rg, byte, packed): eight booleans a byte, the least bit first, the last byte filled with zeros; nulls take no bit."""
    numbered = df.where("value is not null").select("rg", "value", (F.row_number().over(_in_chunk()) - 1).alias("i"))
    bit = F.when(F.col("value"), F.expr("shiftleft(1, cast(i % 8 as int))")).otherwise(0)
    return numbered.groupBy("rg", F.expr("cast(i div 8 as bigint)").alias("byte")).agg(F.bit_or(bit).cast("long").alias("packed"), F.count("*").alias("n"))


def booleans(packed: DataFrame) -> DataFrame:
    """(rg, i, value) from boolean_bytes()."""
    return packed.select("rg", F.explode(F.expr("transform(sequence(0L, n - 1), k -> struct(byte * 8 + k as i, (shiftright(packed, cast(k as int)) & 1) = 1 as value))")).alias("x")).select("rg", "x.i", "x.value")


def dictionary(df: DataFrame) -> DataFrame:
    """(rg, index, value): distinct values in order of first appearance, from zero. Nulls have no entry."""
    first = df.where("value is not null").groupBy("rg", "value").agg(F.min("pos").alias("first"))
    return first.select("rg", (F.row_number().over(_in_chunk("first")) - 1).cast("long").alias("index"), "value")


def dictionary_indices(df: DataFrame, entries: DataFrame) -> DataFrame:
    """(rg, pos, index) of the values that are not null. A chunk's dictionary has as many entries as the chunk rows at most."""
    return df.join(entries.withColumnsRenamed({"rg": "__rg", "value": "__v"}), (F.col("rg") == F.col("__rg")) & (F.col("value") == F.col("__v"))).select("rg", "pos", "index")


def dictionary_values(indices: DataFrame, entries: DataFrame) -> DataFrame:
    """(rg, pos, value). An index that the dictionary lacks is an error."""
    both = indices.join(entries, ["rg", "index"], "left")
    fits = F.when(F.col("value").isNull(), F.raise_error(F.lit("dictionary index out of range"))).otherwise(F.col("value"))
    return both.select("rg", "pos", fits.alias("value"))


def dictionary_sizes(df: DataFrame) -> DataFrame:
    """(rg, entries, dict_bytes, width): entries, their plain bytes (strings), bits of an index."""
    sizes = dictionary(df).groupBy("rg").agg(F.count("*").alias("entries"), F.sum(F.octet_length("value") + 4).cast("long").alias("dict_bytes"))
    return sizes.withColumn("width", bit_width(F.col("entries") - 1))


def runs(df: DataFrame) -> DataFrame:
    """(rg, start, n, value): maximal runs of equal values."""
    marked = df.withColumn("__island", F.row_number().over(_in_chunk()) - F.row_number().over(Window.partitionBy("rg", "value").orderBy("pos")))
    return marked.groupBy("rg", "value", "__island").agg(F.min("pos").alias("start"), F.count("*").alias("n")).select("rg", "start", "n", "value")


def hybrid(df: DataFrame, least: int = 8) -> DataFrame:
    """(rg, start, n, rle, value): runs of `least` or more by themselves, all between two of them as one literal stretch."""
    by_start = _in_chunk("start")
    numbered = runs(df).withColumn("__rle", F.col("n") >= least).withColumn("__after", F.sum(F.col("__rle").cast("int")).over(by_start))
    return numbered.groupBy("rg", "__after", "__rle").agg(F.min("start").alias("start"), F.sum("n").cast("long").alias("n"), F.min("value").alias("__v")).select(
        "rg", "start", "n", F.col("__rle").alias("rle"), F.when(F.col("__rle"), F.col("__v")).alias("value")
    )


def unrun(encoded: DataFrame) -> DataFrame:
    """(rg, pos, value) from runs()."""
    return encoded.select("rg", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos"), "value")


def _wrapped(x: Column) -> Column:
    """A whole number as the long that it is modulo 2^64."""
    turn, half = F.lit(Decimal(1 << 64)), F.lit(Decimal(1 << 63))
    return (F.pmod(x + half, turn) - half).cast("long")


def deltas(df: DataFrame) -> DataFrame:
    """(rg, pos, i, first, delta): differences to the value before, which wrap at 64 bits; the first row has its value and no
    difference. Nulls have no place."""
    moved = F.coalesce(F.try_subtract("value", "__b"), _wrapped(F.col("value").cast("decimal(20,0)") - F.col("__b").cast("decimal(20,0)")))
    numbered = df.where("value is not null").select("rg", "pos", (F.row_number().over(_in_chunk()) - 1).cast("long").alias("i"), "value", F.lag("value").over(_in_chunk()).alias("__b"))
    return numbered.select("rg", "pos", "i", F.when(F.col("i") == 0, F.col("value")).alias("first"), moved.alias("delta"))


def delta_blocks(df: DataFrame) -> DataFrame:
    """(rg, block, miniblock, least, width): blocks of 128 differences, filled with zeros before the least is taken, and the
    bits that the largest difference to it needs in each 32."""
    moved = deltas(df).where("i > 0").select("rg", F.expr("(i - 1) div 128").alias("block"), F.expr("((i - 1) % 128) div 32").alias("miniblock"), "delta")
    whole = moved.groupBy("rg", "block").agg(F.min("delta").alias("__m"), F.count("*").alias("__n"))
    whole = whole.select("rg", "block", "__n", F.when(F.col("__n") < BLOCK, F.least("__m", F.lit(0))).otherwise(F.col("__m")).alias("least"))
    top = moved.groupBy("rg", "block", "miniblock").agg(F.max("delta").alias("__x"), F.count("*").alias("__k"))
    both = top.join(whole, ["rg", "block"])
    largest = F.when(F.col("__k") < MINIBLOCK, F.greatest("__x", F.lit(0))).otherwise(F.col("__x"))
    beyond = F.coalesce(F.try_subtract(largest, F.col("least")), F.lit(-1))  # beyond 63 bits: the width is 64
    return both.select("rg", "block", "miniblock", "least", bit_width(beyond).alias("width"))


def undelta(encoded: DataFrame) -> DataFrame:
    """(rg, pos, value) from deltas()."""
    so_far = F.sum(F.coalesce("first", "delta").cast("decimal(20,0)")).over(_in_chunk().rowsBetween(Window.unboundedPreceding, 0))
    return encoded.select("rg", "pos", _wrapped(so_far).alias("value"))


def lengths(df: DataFrame) -> DataFrame:
    """(rg, pos, length, offset): bytes of each string and where it begins in the chunk's joined bytes."""
    size = F.octet_length("value").cast("long")
    return df.select("rg", "pos", size.alias("length"), F.coalesce(F.sum(size).over(_in_chunk().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"))


def joined(df: DataFrame) -> DataFrame:
    """(rg, blob): the chunk's strings one after another. A chunk has a bounded number of rows."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])
    return df.groupBy("rg").agg(F.encode(F.array_join(parts, ""), "UTF-8").alias("blob"))


def unjoined(places: DataFrame, blobs: DataFrame) -> DataFrame:
    """(rg, pos, value) from lengths() and joined()."""
    cut = F.expr("decode(substring(blob, cast(offset as int) + 1, cast(length as int)), 'UTF-8')")
    return places.join(blobs, "rg").select("rg", "pos", cut.alias("value"))


def prefixes(df: DataFrame) -> DataFrame:
    """(rg, pos, prefix, suffix): bytes shared with the string before, and the rest; the first shares none. ASCII and other
    UTF-8 alike: bytes are compared, and the suffix is hex so that it may begin inside a character. Nulls have no place."""
    both = df.where("value is not null").select("rg", "pos", F.hex(F.encode("value", "UTF-8")).alias("__h"), F.lag(F.hex(F.encode("value", "UTF-8"))).over(_in_chunk()).alias("__b"))
    same = F.expr("case when __b is null then 0 else coalesce(array_position(transform(sequence(1, greatest(1, least(length(__h), length(__b)) div 2)), i -> substring(__h, 2 * i - 1, 2) = substring(__b, 2 * i - 1, 2)), false), 0) end")
    shared = F.expr("case when __b is null or least(length(__h), length(__b)) = 0 then 0 when __at = 0 then least(length(__h), length(__b)) div 2 else __at - 1 end")
    return both.withColumn("__at", same).withColumn("prefix", shared.cast("long")).select("rg", "pos", "prefix", F.expr("substring(__h, cast(2 * prefix as int) + 1, length(__h))").alias("suffix"))


def unprefixed(encoded: DataFrame) -> DataFrame:
    """(rg, pos, value) from prefixes(): each string needs the one before, so a chunk is read in order by one task."""
    steps = F.array_sort(F.collect_list(F.struct("pos", "prefix", "suffix")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rg, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before, values = b"", []
                for step in chunk:
                    before = before[: step["prefix"]] + bytes.fromhex(step["suffix"])
                    values.append(before.decode())
                yield pa.RecordBatch.from_pydict({"rg": pa.array([rg] * len(chunk), pa.int64()), "pos": pa.array([x["pos"] for x in chunk], pa.int64()), "value": pa.array(values, pa.string())})

    return encoded.groupBy("rg").agg(steps.alias("steps")).mapInArrow(run, "rg bigint, pos bigint, value string")
