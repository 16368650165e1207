"""Chosen row groups of Parquet data, in any order, repeats allowed: one task for those that follow each other in a file, up to
a bound of bytes.

Row groups are numbered through all files of the path in the order of their names.
"""

from __future__ import annotations

from bisect import bisect_right
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Footers that are read side by side to number the row groups.
FOOTERS_AT_ONCE = 32
#: Bytes of the row groups of a task, before compression; a larger group has a task of its own. A task reads its file's footer
#: once, so that many small groups cost neither a task nor a footer each.
TASK_BYTES = 32 << 20


class _Groups(InputPartition):
    """Row groups of one file: the place of the first of them, the number of the file's first group, and their numbers in the file."""

    def __init__(self, place: int, base: int, path: str, groups: list[int]):
        super().__init__((place, base, path, groups))


class RowGroupReader(DataSourceReader):
    def __init__(self, path: str, wanted: list[int] | None, schema: T.StructType):
        self.path, self.wanted, self.columns = path, wanted, schema

    def partitions(self):
        import pyarrow.parquet as pq

        from shalegrid.sources.files import data_files, filesystem

        def sizes(p: str) -> list[int]:
            system, plain = filesystem(p)
            with system.open_input_file(plain) as f:
                m = pq.ParquetFile(f).metadata
            return [m.row_group(g).total_byte_size for g in range(m.num_row_groups)]

        files = data_files(self.path)
        with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:  # footers only; the wait is for the store, not for work
            held = list(pool.map(sizes, files))
        starts = list(accumulate(map(len, held), initial=0))
        tasks, last, room = [], -1, 0
        for place, i in enumerate(range(starts[-1]) if self.wanted is None else self.wanted):
            if not 0 <= i < starts[-1]:
                raise IndexError(f"row group {i} is out of range; there are {starts[-1]}")
            k = bisect_right(starts, i) - 1
            n = held[k][i - starts[k]]
            if k != last or n > room:
                tasks.append(_Groups(place, starts[k], files[k], []))
                last, room = k, TASK_BYTES
            tasks[-1].value[3].append(i - starts[k])
            room -= n
        return tasks or [_Groups(-1, -1, "", [])]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        from shalegrid.sources.files import filesystem

        place, base, path, groups = partition.value
        if place < 0:
            return
        names = to_arrow_schema(self.columns)
        own = [n for n in names.names if n not in ("row_group", "place")]
        system, plain = filesystem(path)
        with system.open_input_file(plain) as f:
            file, done = pq.ParquetFile(f), 0
            numbers, ends = np.array(groups), np.cumsum([file.metadata.row_group(g).num_rows for g in groups])
            for batch in file.iter_batches(8192, row_groups=groups, columns=own):  # a batch may hold rows of several groups
                at = np.searchsorted(ends, np.arange(done, done + batch.num_rows), side="right")
                done += batch.num_rows
                extra = {"row_group": base + numbers[at], "place": place + at}
                arrays = [batch.column(n).cast(names.field(n).type) if n in own else pa.array(extra[n], pa.int64()) for n in names.names]
                yield pa.RecordBatch.from_arrays(arrays, schema=names)


class RowGroups(DataSource):
    """format("parquet_row_groups").schema(...).option("row_groups", "0,2,2").load(path); without the option, all of them.

    Columns row_group and place in the schema get the group's number and its place in the option."""

    @classmethod
    def name(cls):
        return "parquet_row_groups"

    def reader(self, schema):
        wanted = self.options.get("row_groups")
        return RowGroupReader(self.options["path"], None if wanted is None else [int(x) for x in wanted.split(",") if x.strip()], schema)


def scan_row_groups(spark: SparkSession, path: str, groups: list[int] | None, schema: T.StructType, numbered: bool = False) -> DataFrame:
    spark.dataSource.register(RowGroups)
    if numbered:
        schema = T.StructType([*schema.fields, T.StructField("row_group", T.LongType()), T.StructField("place", T.LongType())])
    reader = spark.read.format("parquet_row_groups").schema(schema)
    if groups is not None:
        reader = reader.option("row_groups", ",".join(map(str, groups)))
    return reader.load(path)
