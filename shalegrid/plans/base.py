"""How a module of queries declares them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shalegrid.session import workspace
from shalegrid.sources.sink import WriteOptions, write, write_row_groups

#: Rows of a row group, and of a chunk whose encoding state is its own.
GROUP, CHUNK = 100, 1000


def declaring() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries, oracles = {}, {}

    def query(sql: str | None = None, name: str | None = None):
        def keep(f):
            queries[name or f.__name__] = f
            if sql is not None:
                oracles[name or f.__name__] = sql
            return f

        return keep

    return queries, oracles, query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, options: WriteOptions = WriteOptions()) -> DataFrame:
    """df after a write and a read."""
    path = workspace(df.sparkSession, label)
    write(df, path, options)
    return df.sparkSession.read.parquet(path)


def grouped_events(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(path, events): the events written in row groups of GROUP rows by event_id."""
    events = table(spark, sf_dir, "events")
    path = workspace(spark, "events")
    write_row_groups(events, path, "event_id", GROUP)
    return path, events
