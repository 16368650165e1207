"""Plumbing shared by the training-data operators: Arrow batch maps, staged tables, size checks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shalegrid.session import discard, workspace

#: Rows and bytes of strings that a table may have to be sent to every executor; a larger one is joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 1 << 25
#: Bits of a sieve for each of its keys, 64-bit words of a block of it, and its blocks at most: 32 MB, sent to every executor.
SIEVE_BITS, SIEVE_WORDS, SIEVE_BLOCKS = 16, 64, 1 << 16
#: Bytes of a portion of an Arrow batch that is made into Python objects at once, about.
PORTION = 1 << 23
#: The setting for the bytes of a whole Arrow batch, which an executor holds on both sides of the pipe.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: computed once, lineage cut, safe when executors are lost."""
    spark = df.sparkSession
    path = workspace(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        discard(df.sparkSession, df._staged_path)


def _bound_batches(spark: SparkSession) -> None:
    """Batches of a portion's size, not of 64 MB, unless the session says otherwise; a single longer row is a batch of its own."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(PORTION))


def _portions(batches: Iterable[pa.RecordBatch], size: int = PORTION, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in portions of so many rows and about so many bytes: what a portion's Python objects take is bounded."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, step):
            yield batch.slice(k, step)


def map_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[list[list]], list[list]]], out: T.StructType, size: int = PORTION) -> DataFrame:
    """Arrow batches of the named columns through make()(their lists), which returns one list for each field of out.

    make runs once a task, so that what it loads stays in the worker. size: a portion's bytes, less where much is made of each.
    """
    arrow = _arrow_schema(out)
    _bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in _portions(batches, size):
            made = f([c.to_pylist() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(made, arrow, strict=True)], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def filter_rows(df: DataFrame, columns: list[str], make: Callable[[], Callable[[list[list]], list[bool]]]) -> DataFrame:
    """The rows, all columns kept, for which make()(lists of the named columns) is true."""
    at = [df.columns.index(c) for c in columns]
    _bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in _portions(batches):
            yield batch.filter(pa.array(f([batch.column(i).to_pylist() for i in at]), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def fields(spec: str) -> T.StructType:
    return T.StructType.fromDDL(spec)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows, and bytes in their strings and arrays; counts no further than that many rows."""
    width = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    width += [F.greatest(F.size(f.name), F.lit(0)) * 32 for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    total = F.coalesce(F.sum(sum(width, F.lit(0)).cast("long")), F.lit(0))
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), total.alias("b")).first()
    return seen["n"] <= rows and seen["b"] <= size


def joined(left: DataFrame, right: DataFrame, on: str | Column, rows: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has so many rows at most: few are sent to every task, else both sides are shuffled.

    Spark's own guess goes by the size of the files that a plan reads. It knows neither how far they are compressed nor that
    an explode multiplies rows, and a table sent by a wrong guess passes through the driver, whose memory it can fill.
    """
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right.hint("merge"), on, how)


def sieve(keys: DataFrame, key: Column, rows: int) -> DataFrame:
    """A Bloom filter of so many keys (key: a hash, bigint), staged: (block, words). Each key sets four bits of one word.

    Its bytes are bounded: beyond the bound more rows than need be pass as hits, none is missed.
    """
    blocks = max(1, min(SIEVE_BLOCKS, BROADCAST_ROWS, rows * SIEVE_BITS // (64 * SIEVE_WORDS) + 1))
    block, word, mask = _sieve_place(key, blocks, SIEVE_WORDS)
    masks = keys.select(block.alias("block"), word.alias("word"), mask.alias("mask")).groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))
    known = masks.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("known"))
    words = F.transform(F.sequence(F.lit(0), F.lit(SIEVE_WORDS - 1)), lambda w: F.coalesce(F.try_element_at("known", w), F.lit(0).cast("long")))
    out = staged(known.select("block", words.alias("words")), "sieve")
    out._shape = blocks, SIEVE_WORDS
    return out


def _sieve_place(key: Column, blocks: int, words: int) -> tuple[Column, Column, Column]:
    """Block, word and bits of a key."""
    other = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned(other, 32 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(key, F.lit(blocks).cast("long")), F.pmod(F.shiftright(other, 8), F.lit(words).cast("long")).cast("int"), mask


def sifted(df: DataFrame, key: Column, by: DataFrame, hit: bool) -> DataFrame:
    """The rows of df whose key is in the sieve, and a few others (hit), or all the other rows; nothing is shuffled."""
    own_block, own_words = unused(df, "block", "words")
    block, word, mask = _sieve_place(key, *by._shape)
    table = by.select(F.col("block").alias(own_block), F.col("words").alias(own_words))
    found = F.coalesce(F.get(own_words, word).bitwiseAND(mask) == mask, F.lit(False))
    return df.join(F.broadcast(table), block == F.col(own_block), "left").where(found if hit else ~found).drop(own_block, own_words)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    have = {c.lower() for c in df.columns}
    width = 2
    while any(("_" * width + n).lower() in have for n in names):
        width += 1
    return ["_" * width + n for n in names]


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def lowered(text: str) -> str:
    """Lower case, character by character where the whole would change its length, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def null_to_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
