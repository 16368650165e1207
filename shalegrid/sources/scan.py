"""Scans of Parquet data as DataFrames."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The rows at path; with columns, only those are read."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")
    return df.select(*columns)


def scan_bytes(blobs: DataFrame, schema: T.StructType, column: str = "content") -> DataFrame:
    """The rows of Parquet files that stand whole in a binary column, one task's files after another, batch by batch."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        names = to_arrow_schema(schema)
        for batch in batches:
            for blob in batch.column(0):
                for rows in pq.ParquetFile(io.BytesIO(blob.as_py())).iter_batches(8192, columns=schema.fieldNames()):
                    yield rows.select(schema.fieldNames()).cast(names)

    return blobs.select(column).mapInArrow(decoded, schema)


def merge(parts: list[DataFrame]) -> DataFrame:
    """The parts' rows together, columns by name. Parts whose columns or types differ are an error."""
    kinds = [sorted((f.name, f.dataType.simpleString()) for f in p.schema) for p in parts]
    if any(k != kinds[0] for k in kinds):
        raise ValueError("the parts' columns differ")
    return reduce(DataFrame.unionByName, parts)
