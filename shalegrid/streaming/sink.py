"""Streams to Parquet: each micro-batch is appended and committed at once, so memory follows the batch, not the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shalegrid.sources.sink import WriteOptions


def append_stream(stream: DataFrame, path: str, checkpoint: str, options: WriteOptions = WriteOptions()) -> StreamingQuery:
    """Writes all that is there now and stops; started again with the same checkpoint it goes on where it ended."""
    return stream.writeStream.format("parquet").outputMode("append").options(**options.settings()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def write_batches(batches: list[DataFrame], path: str, options: WriteOptions = WriteOptions()) -> None:
    """Appends the batches one after another; each is durable before the next begins."""
    for batch in batches:
        batch.write.mode("append").options(**options.settings()).parquet(path)
