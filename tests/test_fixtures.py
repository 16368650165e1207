"""Literal inputs: levels, encodings, footers, options, encryption, errors."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shalegrid.functions import bits, crypto, hashing
from shalegrid.operators import bloom
from shalegrid.operators import encodings as E
from shalegrid.operators import payloads as P
from shalegrid.operators.nested import assemble_list, assemble_map, assemble_nested_list, assemble_struct, shred
from shalegrid.operators.schema import SchemaBuilder, leaves
from shalegrid.operators.stats import chunk_stats
from shalegrid.sources import row_groups, sink
from shalegrid.sources.encrypted import read_encrypted, write_encrypted
from shalegrid.sources.footers import footers
from shalegrid.sources.row_groups import scan_row_groups
from shalegrid.sources.scan import merge, scan, scan_bytes
from shalegrid.sources.sink import SNAPPY, WriteOptions, write, write_row_groups
from shalegrid.streaming.sink import append_stream, write_batches


def levels(spark, kind, value, path):
    df = spark.createDataFrame([(1, value)], f"id int, c {kind}").select("id", "c")
    rows = shred(df, "id", path).collect()
    places = [c for c in rows[0].asDict() if c[0] == "p"]
    rows.sort(key=lambda r: [-1 if r[p] is None else r[p] for p in places])
    return [(r["def"], r["rep"], r["value"]) for r in rows]


def test_levels_of_nested_lists(spark):
    want = {None: [(0, 0, None)], "[]": [(1, 0, None)], "[N]": [(2, 0, None)], "[[]]": [(3, 0, None)], "full": [(5, 0, 1), (4, 2, None), (5, 1, 2)]}
    values = {None: None, "[]": [], "[N]": [None], "[[]]": [[]], "full": [[1, None], [2]]}
    for k, v in values.items():
        assert levels(spark, "array<array<int>>", v, "c.list.element.list.element") == want[k]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values.values())], "id int, c array<array<int>>")
    back = assemble_nested_list(shred(df, "id", "c.list.element.list.element"), "id", "c").collect()
    assert {r["id"]: r["c"] for r in back} == dict(enumerate(values.values()))


def test_levels_of_tags(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"]), (3, [])], "id int, tags array<string>")
    rows = shred(df, "id", "tags.list.element").orderBy("id", "p1").collect()
    assert [r["def"] for r in rows] == [3, 3, 3, 3, 1] and [r["rep"] for r in rows] == [0, 1, 1, 0, 0]


def test_lists_keep_nulls(spark):
    values = {1: None, 2: [], 3: [None], 4: [1, None, 2]}
    df = spark.createDataFrame([*values.items()], "id int, c array<int>")
    assert {r["id"]: r["c"] for r in assemble_list(shred(df, "id", "c.list.element"), "id", "c").collect()} == values


def test_list_of_structs_and_second_struct(spark):
    assert levels(spark, "array<struct<a:int,b:string>>", [(1, "x"), None, (None, "y")], "c.list.element.a") == [(4, 0, 1), (2, 1, None), (3, 1, None)]
    df = spark.createDataFrame([(1, 7, (1, None)), (2, 8, None), (3, 9, (None, "z"))], "id int, k int, s struct<a:int,b:string>")
    back = assemble_struct({f: shred(df, "id", f"s.{f}") for f in "ab"}, "id", "s", 1).orderBy("id").collect()
    assert [r["s"] and tuple(r["s"]) for r in back] == [(1, None), None, (None, "z")]


def test_two_lists_and_maps(spark):
    df = spark.createDataFrame([(1, [1], ["a", "b"], {"x": 10, "y": None}), (2, [], None, {}), (3, None, [], None)], "id int, p array<int>, q array<string>, m map<string,int>")
    assert [x.path for x in leaves(df.schema)] == ["id", "p.list.element", "q.list.element", "m.key_value.key", "m.key_value.value"]
    assert shred(df, "id", "q.list.element").where("value is not null").count() == 2
    back = assemble_map(shred(df, "id", "m.key_value.key"), shred(df, "id", "m.key_value.value"), "id", "m").collect()
    assert {r["id"]: r["m"] for r in back} == {1: {"x": 10, "y": None}, 2: {}, 3: None}
    with pytest.raises(ValueError, match="no leaf"):
        shred(df, "id", "p.element")


def chunk(spark, values, kind, rows=1000):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"pos bigint, value {kind}").repartition(5)
    return E.chunked(df, "pos", F.col("value"), rows)


def values_of(df):
    return [r["value"] for r in df.orderBy("rg", "pos").collect()]


def test_dictionary(spark):
    df = chunk(spark, list("ABACBACA"), "string")
    entries = E.dictionary(df)
    assert [r["value"] for r in entries.orderBy("index").collect()] == ["A", "B", "C"]
    indices = E.dictionary_indices(df, entries)
    assert [r["index"] for r in indices.orderBy("pos").collect()] == [0, 1, 0, 2, 1, 0, 2, 0]
    assert E.dictionary_sizes(df).first()["width"] == 2
    assert values_of(E.dictionary_values(indices, entries)) == list("ABACBACA")
    with pytest.raises(Exception, match="out of range"):
        E.dictionary_values(indices.withColumn("index", F.col("index") + 9), entries).collect()


def test_large_dictionary(spark):
    df = chunk(spark, [f"v{i:05d}" for i in range(40_000)], "string", 100_000)
    assert E.dictionary_sizes(df).first()[:] == (0, 40_000, 40_000 * 10, 16)


def test_runs(spark):
    values = [0] * 8 + [1] * 8 + [0, 1, 0, 1]
    rows = E.hybrid(chunk(spark, values, "bigint")).orderBy("start").collect()
    assert [(r["n"], r["rle"], r["value"]) for r in rows] == [(8, True, 0), (8, True, 1), (4, False, None)]
    mixed = [1] + [0] * 8 + [1, 0, 1] + [1] * 9 + [0]
    assert values_of(E.unrun(E.runs(chunk(spark, mixed, "bigint")))) == mixed


def test_deltas(spark):
    values = [100, 102, 105, 110, 115, 120, 130, 140, 150, 200]
    df = chunk(spark, values, "bigint")
    assert [r["delta"] for r in E.deltas(df).orderBy("pos").collect()][1:] == [b - a for a, b in zip(values, values[1:])]
    assert E.delta_blocks(df).first()[:] == (0, 0, 0, 0, 6)
    rnd = random.Random(2)
    many = [rnd.randint(-(10**12), 10**12) for _ in range(300)]
    assert values_of(E.undelta(E.deltas(chunk(spark, many, "bigint")))) == many


@pytest.mark.parametrize("n", [1, 7, 8, 9, 17])
def test_booleans(spark, n):
    values = [i % 3 == 0 for i in range(n)]
    packed = E.boolean_bytes(chunk(spark, values, "boolean", 10))
    assert [r["value"] for r in E.booleans(packed).orderBy("rg", "i").collect()] == values


def test_strings(spark):
    values = [f"Customer#{i:09d}" for i in range(60)] + ["", "é", "éa", "ë", "日本", "日本語"]
    df = chunk(spark, values, "string", 40)
    assert values_of(E.unprefixed(E.prefixes(df))) == values
    assert values_of(E.unjoined(E.lengths(df), E.joined(df))) == values
    assert E.prefixes(df).where("pos = 41").first()["prefix"] == 17


def test_bits(spark):
    values = [0, 1, -1, 2, 63, -64, 2**62, -(2**62), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", bits.zigzag(F.col("v")).alias("z"))
    rows = df.select("v", "z", bits.unzigzag(F.col("z")).alias("b"), bits.uleb_length(F.col("z")).alias("n")).collect()
    for r in rows:
        z = r["z"] % 2**64
        assert r["b"] == r["v"] and z == (2 * r["v"] if r["v"] >= 0 else -2 * r["v"] - 1) and r["n"] == max(1, -(-z.bit_length() // 7))
    widths = spark.range(9).select(bits.bit_width(F.col("id"))).collect()
    assert [r[0] for r in widths] == [i.bit_length() for i in range(9)]


def test_hashes(spark):
    names = ["", "hello", "日本"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    for r in df.select("s", hashing.crc32(F.col("s")).alias("c"), hashing.xxhash64(F.col("s")).alias("h"), hashing.xxhash64_of_seed(F.col("s"), 0).alias("z")).collect():
        raw = r["s"].encode()
        assert (r["c"], r["h"] % 2**64, r["z"] % 2**64) == (zlib.crc32(raw), xxhash.xxh64_intdigest(raw, 42), xxhash.xxh64_intdigest(raw, 0))


def test_bloom_loses_nothing(spark):
    members = spark.range(0, 3000, 3).toDF("k")
    blocks = bloom.blocks_for(1000)
    got = bloom.might_contain(spark.range(3000).toDF("k"), "k", bloom.build(members, "k", blocks), blocks)
    found = {r["k"] for r in got.collect()}
    assert found >= set(range(0, 3000, 3)) and len(found) < 1100
    assert bloom.blocks_for(100) == 4 and bloom.blocks_for(1) == 1


def test_statistics_with_nulls(spark):
    df = spark.createDataFrame([(0, None, "b"), (0, 50, "é"), (0, 10, None), (1, None, None)], "rg int, v bigint, s string")
    rows = {r["rg"]: r for r in chunk_stats(df, F.col("rg"), ["v", "s"]).collect()}
    assert rows[0][:] == (0, 3, 10, 50, 1, "b", "é", 1) and rows[1][:] == (1, 1, None, None, 1, None, None, 1)


def test_write_options(spark, tmp_path):
    orders = spark.read.parquet(f"{DATA}/sf0.001/orders.parquet").coalesce(1)
    for name, options in {"gzip": WriteOptions("gzip"), "plain": WriteOptions("none", dictionary=False, statistics=False), "v2": WriteOptions("zstd", dictionary=True, page_version=2, rows_per_group=100)}.items():
        write(orders, f"{tmp_path}/{name}", options)
        chunks = footers(spark, f"{tmp_path}/{name}", "column")
        assert {r[0].lower() for r in chunks.select("codec").distinct().collect()} == {{"none": "uncompressed"}.get(options.compression, options.compression)}
        strings = chunks.where("path = 'o_orderpriority'").first()
        assert ("DICTIONARY" in strings["encodings"]) == options.dictionary
        assert (strings["min_value"] is not None) == options.statistics
        assert footers(spark, f"{tmp_path}/{name}").first()["n_row_groups"] == (15 if options.rows_per_group else 1)
        assert scan(spark, f"{tmp_path}/{name}").exceptAll(orders).count() == 0
    write(orders, f"{tmp_path}/bloom", WriteOptions(bloom=(("o_custkey", 100),)))
    for bad in ("brotli", "lzo"):
        with pytest.raises(ValueError, match="unsupported"):
            WriteOptions(bad)


def test_row_groups(spark, tmp_path):
    path = f"{tmp_path}/groups"
    batches = [[(1, "Alice"), (2, "Bob"), (3, "Charlie")], [(4, "Diana"), (5, "Eve")], [(6, "Frank")]]
    schema = "id bigint, name string"
    pq.write_table(pa.table({"id": pa.array([], pa.int64()), "name": pa.array([], pa.string())}), f"{tmp_path}/empty.parquet")
    for i, b in enumerate(batches):
        write_batches([spark.createDataFrame(b, schema).coalesce(1)], f"{path}/{i}", SNAPPY)
    kind = spark.createDataFrame([], schema).schema
    assert sorted(r["n_rows"] for r in footers(spark, path, "row_group").collect()) == [1, 2, 3]
    assert scan_row_groups(spark, path, [2, 0, 2], kind).count() == 5
    assert scan_row_groups(spark, path, [], kind).count() == 0
    assert scan_row_groups(spark, path, None, kind).count() == 6
    with pytest.raises(Exception, match="out of range"):
        scan_row_groups(spark, path, [3], kind).collect()
    assert scan(spark, f"{tmp_path}/empty.parquet").columns == ["id", "name"]
    write_row_groups(spark.range(1000).repartition(7), f"{tmp_path}/r", "id", 64)
    rows = scan_row_groups(spark, f"{tmp_path}/r", None, spark.range(1).schema, numbered=True).groupBy("row_group").agg(F.min("id"), F.count("*")).collect()
    assert sorted(r[:] for r in rows) == [(g, 64 * g, min(64, 1000 - 64 * g)) for g in range(16)]


def test_many_small_row_groups(spark, tmp_path, monkeypatch):
    """Neither a file's groups nor the tasks follow the number of groups: each task parses its file's whole footer."""
    monkeypatch.setattr(sink, "GROUPS_A_FILE", 100)
    write_row_groups(spark.range(4000).repartition(7), f"{tmp_path}/r", "id", 2)
    held = [r["n_row_groups"] for r in footers(spark, f"{tmp_path}/r").collect()]
    assert sum(held) == 2000 and max(held) < 150
    back = scan_row_groups(spark, f"{tmp_path}/r", None, spark.range(1).schema, numbered=True)
    assert back.rdd.getNumPartitions() == len(held)
    assert back.where("row_group <> id div 2 or place <> row_group").count() == 0 and back.select("id").distinct().count() == 4000


def test_row_groups_of_a_task(spark, tmp_path, monkeypatch):
    rows, at = [1, 0, 3, 10_000, 2], 0
    with pq.ParquetWriter(f"{tmp_path}/a.parquet", pa.schema([("id", pa.int64())])) as out:
        for n in rows:
            out.write_table(pa.table({"id": pa.array(range(at, at + n), pa.int64())}), row_group_size=20_000)
            at += n
    pq.write_table(pa.table({"id": [at, at + 1]}), f"{tmp_path}/b.parquet")
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "row_group", "place")])
    first, count = [0, 1, 1, 4, 10_004, 10_006], [*rows, 2]
    for most, tasks in ((row_groups.TASK_BYTES, [[0, 1, 2, 3, 4], [0]]), (1000, [[0, 1, 2], [3], [4], [0]])):
        monkeypatch.setattr(row_groups, "TASK_BYTES", most)
        assert [p.value[3] for p in row_groups.RowGroupReader(f"{tmp_path}", None, schema).partitions()] == tasks
        for wanted in (None, [3, 5, 3, 0, 0, 2]):
            reader = row_groups.RowGroupReader(f"{tmp_path}", wanted, schema)
            got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
            assert got == [(first[g] + k, g, place) for place, g in enumerate(range(6) if wanted is None else wanted) for k in range(count[g])]


def test_scans(spark, tmp_path):
    pq.write_table(pa.table({"x": [1, 2, None], "y": ["a", None, "c"]}), f"{tmp_path}/foreign.parquet", compression="zstd", data_page_version="2.0")
    df = scan(spark, f"{tmp_path}/foreign.parquet")
    want = [(1, "a"), (2, None), (None, "c")]
    assert sorted(df.collect(), key=repr) == sorted(want, key=repr)
    blobs = spark.read.format("binaryFile").load(f"{tmp_path}/foreign.parquet")
    assert sorted(scan_bytes(blobs, df.schema).collect(), key=repr) == sorted(want, key=repr)
    assert "ReadSchema: struct<y:string>" in scan(spark, f"{tmp_path}/foreign.parquet", ["y"])._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="no column"):
        scan(spark, f"{tmp_path}/foreign.parquet", ["z"])
    with pytest.raises(ValueError, match="differ"):
        merge([df, df.select("x")])


def test_stream(spark, tmp_path):
    write_batches([spark.range(k * 100, k * 100 + 100).coalesce(1) for k in range(3)], f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        append_stream(stream, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [*range(300)]


def test_encryption(spark, tmp_path):
    key, other = b"\x42" * 16, b"\x43" * 16
    df = spark.createDataFrame([(1, "Secret data"), (2, "")], "x int, s string")
    sealed = df.select("x", "s", crypto.encrypt(F.col("s"), key, b"aad").alias("e"))
    assert sealed.where(crypto.decrypt(F.col("e"), key, b"aad").cast("string") == F.col("s")).count() == 2
    assert sealed.where(crypto.try_decrypt(F.col("e"), other, b"aad").isNotNull() | crypto.try_decrypt(F.col("e"), key, b"dad").isNotNull()).count() == 0
    with pytest.raises(Exception):
        sealed.select(crypto.decrypt(F.col("e"), other, b"aad")).collect()
    assert crypto.module_aad("data_page", 1, 2, 3) == b"\x02\x01\x00\x02\x00\x03\x00" and crypto.module_aad("footer") == b"\x00"
    path = f"{tmp_path}/sealed"
    write_encrypted(df.coalesce(1), path, {"f": key, "c": other}, "f", {"c": ["s"]})
    (file,) = tmp_path.glob("sealed/*.parquet")
    assert file.read_bytes()[:4] == b"PARE" == file.read_bytes()[-4:]
    assert sorted(read_encrypted(spark, path, {"f": key, "c": other}, df.schema).collect()) == sorted(df.collect())
    for keys in ({"f": key}, {"f": other, "c": other}):
        with pytest.raises(Exception):
            read_encrypted(spark, path, keys, df.schema).collect()
    with pytest.raises(Exception):
        spark.read.parquet(path).collect()


def test_encrypted_appends_and_overwrites(spark, tmp_path):
    keys, path, kind = {"f": b"\x42" * 16}, f"{tmp_path}/sealed", spark.range(1).schema
    for k in range(2):
        write_encrypted(spark.range(10 * k, 10 * k + 10).repartition(3), path, keys, "f")
    assert sorted(r[0] for r in read_encrypted(spark, path, keys, kind).collect()) == [*range(20)]
    write_encrypted(spark.range(100, 105), path, keys, "f", mode="overwrite")
    assert sorted(r[0] for r in read_encrypted(spark, path, keys, kind).collect()) == [*range(100, 105)]


def page_bytes(path, column=0):
    """The bytes of a column's one data page, with its header."""
    chunk = pq.ParquetFile(path).metadata.row_group(0).column(column)
    end = (chunk.dictionary_page_offset or chunk.data_page_offset) + chunk.total_compressed_size
    return path.read_bytes()[chunk.data_page_offset : end]


def plain_table(values, path, **options):
    schema = pa.schema([pa.field("x", pa.int64(), nullable=False)])
    pq.write_table(pa.table({"x": values}, schema=schema), path, compression="none", data_page_version="1.0", **options)


def test_payloads_read_pages_of_another_writer(tmp_path):
    rnd = random.Random(8)
    for k, values in enumerate([[100, 102, 105, 110, 115, 120, 130, 140, 150, 200], [rnd.randint(-(2**62), 2**62) for _ in range(1000)], [-(2**63), 2**63 - 1, 0, -1] * 33, [5]]):
        plain_table(values, path := tmp_path / f"d{k}.parquet", use_dictionary=False, column_encoding={"x": "DELTA_BINARY_PACKED"})
        data = page_bytes(path)
        body = data[data.index(b"\x80\x02\x04") :]  # that writer's blocks have 256 differences
        assert P.undelta(body).tolist() == values == P.undelta(P.delta(np.array(values))).tolist()
    values = [rnd.choice([1, 1, 2, 3]) for _ in range(100)] + [7] * 100 + [rnd.randrange(9) for _ in range(77)] + [4] * 9
    plain_table(values, path := tmp_path / "rle.parquet", use_dictionary=True)
    entries = [*dict.fromkeys(values)]
    indices = [entries.index(v) for v in values]
    data, width = page_bytes(path), P.width_of(len(entries) - 1)
    bodies = [data[i + 1 :] for i in range(len(data) - 1) if data[i] == width]
    assert any(P.unhybrid(b, width, len(values)).tolist() == indices for b in bodies)


@pytest.mark.parametrize("seed", range(6))
def test_payload_round_trips(seed):
    rnd = random.Random(seed)
    for width in (1, 2, 3, 7, 8, 9, 17, 31, 63):
        values = np.array([v for _ in range(30) for v in [rnd.getrandbits(width)] * rnd.choice([1, 1, 2, 7, 8, 9, 20, 300])], np.int64)
        assert P.unpacked(P.packed(values, width), width, len(values)).tolist() == values.tolist()
        assert P.unhybrid(P.hybrid(values, width), width, len(values)).tolist() == values.tolist()
    assert P.unhybrid(b"", 3, 4).tolist() == [0] * 4 == P.unhybrid(b"\x08\x00", 0, 4).tolist()
    # Two runs of eight, then four values packed as one group: a header and the value, twice, and a header and a byte.
    assert P.hybrid(np.array([0] * 8 + [1] * 8 + [0, 1, 0, 1]), 1) == bytes([16, 0, 16, 1, 3, 0b1010])
    assert P.prefixed(b"ab") == b"\x02\0\0\0ab" and P.uleb(300) == b"\xac\x02"
    some = [None, 5, None, None, -1] * 9
    assert P.unpage(P.page(some, 1), 45) == some == P.unpage(P.page(some, 2), 45)


def test_payload_frames(spark):
    values = [3, None, 0, 3, 3, 3, 3, 3, 3, 3, 3, 1, None, 2]
    df = chunk(spark, values, "bigint", 5)
    for kind in P.KINDS:
        rows = P.decoded(P.encoded(df, kind), kind).orderBy("rg", "i").collect()
        assert [r["value"] for r in rows] == [v for v in values if v is not None], kind
    assert P.encoded(df.where("false"), "delta").collect() == []
    assert [r["value"] for r in P.page_values(P.pages(df, 2)).orderBy("rg", "i").collect()] == values


def test_deltas_wrap_and_leave_nulls_out(spark):
    values = [9, -(2**63), 2**63 - 1, None, 0]
    df = chunk(spark, values, "bigint")
    assert values_of(E.undelta(E.deltas(df))) == [v for v in values if v is not None]
    assert E.delta_blocks(df).first()["width"] == 64
    names = chunk(spark, ["abc", None, "abd", None, ""], "string")
    assert [(r["prefix"], r["suffix"]) for r in E.prefixes(names).orderBy("pos").collect()] == [(0, "616263"), (2, "64"), (0, "")]
    assert values_of(E.unprefixed(E.prefixes(names))) == ["abc", "abd", ""]


def test_leaves_are_those_of_written_files(spark, tmp_path):
    """Paths and levels against what the file format's own footer says."""
    from shalegrid.plans.scans import fixture_schemas

    for name, schema in fixture_schemas().items():
        arrow = pa.schema([pa.field(f.name, t.type, f.nullable) for f, t in zip(schema.fields, to_arrow_schema(schema), strict=True)])
        pq.write_table(arrow.empty_table(), f"{tmp_path}/{name}.parquet")
        said = footers(spark, f"{tmp_path}/{name}.parquet", "leaf").orderBy("column").collect()
        assert [(r["path"], r["max_def"], r["max_rep"]) for r in said] == [(x.path, x.max_def, x.max_rep) for x in leaves(schema)], name


def test_every_write_option_shows_in_the_file(spark, tmp_path):
    from shalegrid.plans.sinks import ROUNDTRIPS

    orders = spark.read.parquet(f"{DATA}/sf0.001/orders.parquet").coalesce(1)
    sizes = {}
    for name, options in ROUNDTRIPS.items():
        write(orders, f"{tmp_path}/{name}", options)
        (file,) = (tmp_path / name).glob("*.parquet")
        sizes[name] = file.stat().st_size
        meta = pq.ParquetFile(file).metadata
        chunk = meta.row_group(0).column(orders.columns.index("o_custkey"))
        assert chunk.compression.lower() == {"none": "uncompressed", "lz4_raw": "lz4"}.get(options.compression, options.compression), name
        assert chunk.is_stats_set == options.statistics, name
        assert chunk.has_dictionary_page == options.dictionary, name
        # Version 2 packs keys without a dictionary as deltas; either version's pages are read by another library.
        assert pq.read_table(file).num_rows == orders.count()
    assert sizes["bloom"] >= sizes["uncompressed"] + 10_000 * 10 // 8  # the filter's bits stand in the file
    plain = WriteOptions(page_version=2)
    write(orders, f"{tmp_path}/plain2", plain)
    (file,) = (tmp_path / "plain2").glob("*.parquet")
    assert "DELTA_BINARY_PACKED" in pq.ParquetFile(file).metadata.row_group(0).column(0).encodings


def test_values_of_queries_without_sql(spark):
    from shalegrid.registry import QUERIES

    sf = f"{DATA}/sf0.001"
    names = {r["c_custkey"]: r["c_name"].encode() for r in spark.read.parquet(f"{sf}/customer.parquet").collect()}
    assert {r["c_custkey"]: r["crc"] for r in QUERIES["fn_crc32"](spark, sf).collect()} == {k: zlib.crc32(v) for k, v in names.items()}
    for r in QUERIES["fn_xxhash64"](spark, sf).collect():
        assert (r["seed42"] % 2**64, r["seed0"] % 2**64) == tuple(xxhash.xxh64_intdigest(names[r["c_custkey"]], s) for s in (42, 0))
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert {r["keys"]: r["n"] for r in QUERIES["encrypted_no_key"](spark, sf).collect()} == {"all": n, "footer only": None, "wrong footer": None}
    events = spark.read.parquet(f"{sf}/events.parquet")
    chunks = QUERIES["meta_column_chunks"](spark, sf).groupBy("path").agg(F.sum("n_values").alias("n"), F.min("uncompressed").alias("u")).collect()
    assert {r["path"]: r["n"] for r in chunks} == dict.fromkeys(events.columns, events.count()) and all(r["u"] > 0 for r in chunks)
    for r in QUERIES["meta_kv"](spark, sf).collect():
        fields = json.loads(r["pairs"]["org.apache.spark.sql.parquet.row.metadata"])["fields"]
        assert [(f["name"], f["type"]) for f in fields] == [(f.name, f.dataType.jsonValue()) for f in events.schema]


def test_schema_builder():
    schema = SchemaBuilder().column("name", "string").array("tags", "string").map("scores", "string", "int").build()
    assert [(x.path, x.max_def, x.max_rep) for x in leaves(schema)] == [("name", 0, 0), ("tags.list.element", 3, 1), ("scores.key_value.key", 2, 1), ("scores.key_value.value", 3, 1)]
    with pytest.raises(ValueError):
        SchemaBuilder().column("x", "int96")
    with pytest.raises(ValueError):
        SchemaBuilder().build()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
