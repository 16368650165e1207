"""Footers of Parquet files as tables; no data page is read. One task for each file."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEVELS = {
    "file": "file string, n_rows bigint, n_row_groups bigint, n_columns bigint, created_by string, version string, footer_bytes bigint",
    "row_group": "file string, row_group bigint, n_rows bigint, total_bytes bigint",
    "column": "file string, row_group bigint, column bigint, path string, kind string, codec string, encodings string, n_values bigint, n_nulls bigint, min_value string, max_value string, compressed bigint, uncompressed bigint, data_offset bigint, dictionary_offset bigint",
    "key_value": "file string, key string, value string",
    "leaf": "file string, column bigint, path string, kind string, logical string, max_def bigint, max_rep bigint",
}


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class FooterReader(DataSourceReader):
    def __init__(self, path: str, level: str):
        self.path, self.level = path, level

    def partitions(self):
        from shalegrid.sources.files import data_files

        return [_File(p) for p in data_files(self.path)]

    def read(self, partition):
        import pyarrow.parquet as pq

        from shalegrid.sources.files import filesystem

        system, plain = filesystem(partition.value)
        with system.open_input_file(plain) as f:
            meta = pq.ParquetFile(f).metadata
        name = plain.rsplit("/", 1)[-1]
        yield from getattr(self, f"_{self.level}")(name, meta)

    def _file(self, name, m):
        yield name, m.num_rows, m.num_row_groups, m.num_columns, m.created_by, m.format_version, m.serialized_size

    def _row_group(self, name, m):
        for g in range(m.num_row_groups):
            yield name, g, m.row_group(g).num_rows, m.row_group(g).total_byte_size

    def _column(self, name, m):
        for g in range(m.num_row_groups):
            for c in range(m.num_columns):
                x = m.row_group(g).column(c)
                s = x.statistics
                low, high = (str(s.min), str(s.max)) if s is not None and s.has_min_max else (None, None)
                yield name, g, c, x.path_in_schema, x.physical_type, x.compression, ",".join(sorted(set(x.encodings))), x.num_values, s.null_count if s is not None and s.has_null_count else None, low, high, x.total_compressed_size, x.total_uncompressed_size, x.data_page_offset, x.dictionary_page_offset

    def _key_value(self, name, m):
        for k, v in (m.metadata or {}).items():
            yield name, k.decode(), v.decode(errors="replace")

    def _leaf(self, name, m):
        for c in range(m.num_columns):
            x = m.schema.column(c)
            yield name, c, x.path, x.physical_type, str(x.logical_type.type), x.max_definition_level, x.max_repetition_level


class Footers(DataSource):
    """format("parquet_meta").option("level", one of LEVELS).load(path)"""

    @classmethod
    def name(cls):
        return "parquet_meta"

    def _level(self):
        level = self.options.get("level", "file")
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}; known: {', '.join(LEVELS)}")
        return level

    def schema(self):
        return LEVELS[self._level()]

    def reader(self, schema):
        return FooterReader(self.options["path"], self._level())


def footers(spark: SparkSession, path: str, level: str = "file"):
    spark.dataSource.register(Footers)
    return spark.read.format("parquet_meta").option("level", level).load(path)
