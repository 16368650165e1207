"""Writes of Parquet data: codec, dictionary, page version, statistics, Bloom filters and row-group size as options."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODECS = ("none", "snappy", "gzip", "zstd", "lz4", "lz4_raw")
#: About so many row groups go to a file at most: a footer has an entry for each group and column, and whoever opens the file reads all of them.
GROUPS_A_FILE = 1000


@dataclass(frozen=True)
class WriteOptions:
    compression: str = "none"
    dictionary: bool = False
    statistics: bool = True
    page_version: int = 1
    rows_per_group: int | None = None
    bloom: tuple[tuple[str, int], ...] = ()

    def __post_init__(self):
        if self.compression not in CODECS:
            raise ValueError(f"unsupported compression {self.compression!r}; supported: {', '.join(CODECS)}")
        if self.page_version not in (1, 2):
            raise ValueError("the page version is 1 or 2")

    def settings(self) -> dict[str, str]:
        out = {"compression": self.compression, "parquet.enable.dictionary": str(self.dictionary).lower(), "parquet.column.statistics.enabled": str(self.statistics).lower(), "parquet.writer.version": f"PARQUET_{self.page_version}_0"}
        if self.rows_per_group:
            out["parquet.block.row.count.limit"] = str(self.rows_per_group)
        for column, distinct in self.bloom:
            out |= {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": str(distinct)}
        return out


SNAPPY, GZIP, ZSTD = (WriteOptions(c, dictionary=True) for c in ("snappy", "gzip", "zstd"))


def write(df: DataFrame, path: str, options: WriteOptions = WriteOptions(), mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**options.settings()).parquet(path)


def write_row_groups(df: DataFrame, path: str, order: str, rows: int, options: WriteOptions = WriteOptions()) -> None:
    """Groups of `rows` places of the order column each, which counts from 0 without gaps: ranges of whole groups go to
    tasks, so that file boundaries are group boundaries too. The number of files follows the rows, so that no footer does."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (rows * GROUPS_A_FILE)))
    dealt = df.withColumn("__g", F.expr(f"{order} div {rows}")).repartitionByRange(n, "__g").sortWithinPartitions(order).drop("__g")
    write(dealt, path, replace(options, rows_per_group=rows))
