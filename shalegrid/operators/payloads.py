"""Byte payloads of column chunks, and the values in them: packed bits, run-length hybrid, deltas, plain values, pages.

A chunk's payload is one value of one row, made from and read back into the chunk's rows by Arrow batches; a chunk has a
bounded number of rows (a row group's). Inputs have the columns rg, pos and value. All integers are little-endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the delta encoding: differences of a block, parts of a block. Least run that is written as a run.
BLOCK, PARTS, RUN = 128, 4, 8


def uleb(x: int) -> bytes:
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    return bytes([*out, x])


def read_uleb(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return value, at


def signed_uleb(x: int) -> bytes:
    return uleb(2 * x if x >= 0 else -2 * x - 1)


def read_signed_uleb(data: bytes, at: int) -> tuple[int, int]:
    x, at = read_uleb(data, at)
    return x >> 1 if x % 2 == 0 else -(x >> 1) - 1, at


def packed(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits one after another, the least bit first, in groups of eight filled up with zeros."""
    values = np.asarray(values).astype(np.int64).view(np.uint64)
    bits = np.zeros((-(-len(values) // 8) * 8, width), np.uint8)
    bits[: len(values)] = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    """n values of `width` bits; zeros where the data ends too soon."""
    bits = np.zeros(n * width, np.uint64)
    have = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width]
    bits[: len(have)] = have
    return (bits.reshape(n, width) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def hybrid(values: np.ndarray, width: int) -> bytes:
    """Runs of RUN or more as count and value, what stands between them packed. A packed stretch that a run follows is filled
    up to a multiple of eight from that run, as its header can say no other number."""
    values = np.asarray(values, np.int64)
    if width == 0 or not len(values):
        return b""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    lengths = np.diff(starts, append=len(values))
    out, begin = [], 0

    def literal(end: int) -> None:
        if end > begin:
            out.extend((uleb(-(-(end - begin) // 8) << 1 | 1), packed(values[begin:end], width)))

    long = lengths >= RUN
    for start, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
        fill = (begin - start) % 8
        if n - fill >= RUN:
            literal(start + fill)
            out.extend((uleb(n - fill << 1), int(values[start]).to_bytes(8, "little", signed=True)[: -(-width // 8)]))
            begin = start + n
    literal(len(values))
    return b"".join(out)


def unhybrid(data: bytes, width: int, n: int) -> np.ndarray:
    """n values; zeros where the data ends too soon or the width is zero, what it holds beyond n is left out."""
    parts, have, at, size = [], 0, 0, -(-width // 8)
    while width and have < n and at < len(data):
        header, at = read_uleb(data, at)
        if header & 1:
            count = (header >> 1) * 8
            parts.append(unpacked(data[at : at + count * width // 8], width, count))
            at += count * width // 8
        else:
            count = header >> 1
            parts.append(np.full(min(count, n - have), int.from_bytes(data[at : at + size], "little"), np.int64))
            at += size
        have += count
    return np.concatenate([*parts, np.zeros(max(0, n - have), np.int64)])[:n]


def prefixed(data: bytes) -> bytes:
    """The data behind its length in four bytes, as levels stand in pages of version 1."""
    return struct.pack("<I", len(data)) + data


def delta(values: np.ndarray) -> bytes:
    """Block and part sizes, count and first value; then for each block of differences the least one, four widths, and what
    each difference has beyond the least in so many bits. Differences wrap at 64 bits. A last block counts as filled up with
    zeros; parts without a difference take no bytes."""
    values = np.asarray(values, np.int64)
    if not len(values):
        return b""
    out = [uleb(BLOCK), uleb(PARTS), uleb(len(values)), signed_uleb(int(values[0]))]
    moved = (values[1:].view(np.uint64) - values[:-1].view(np.uint64)).view(np.int64)
    for k in range(0, len(moved), BLOCK):
        there = moved[k : k + BLOCK]
        block = np.concatenate([there, np.zeros(BLOCK - len(there), np.int64)])
        least = block.min()
        beyond = (block.view(np.uint64) - least.view(np.uint64)).reshape(PARTS, -1)
        used = -(-len(there) // (BLOCK // PARTS))
        widths = [int(x.max()).bit_length() for x in beyond[:used]] + [0] * (PARTS - used)
        out += [signed_uleb(int(least)), bytes(widths), *(packed(x.view(np.int64), w) for x, w in zip(beyond, widths, strict=True) if w)]
    return b"".join(out)


def undelta(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    size, at = read_uleb(data, 0)
    parts, at = read_uleb(data, at)
    n, at = read_uleb(data, at)
    first, at = read_signed_uleb(data, at)
    moved, have, each = [], 0, size // parts
    while have < n - 1:
        least, at = read_signed_uleb(data, at)
        widths, at = data[at : at + parts], at + parts
        for w in widths:
            if have < n - 1:
                moved.append(unpacked(data[at : at + each * w // 8], w, each).view(np.uint64) + np.int64(least).view(np.uint64))
                at, have = at + each * w // 8, have + each
    start = np.array([first], np.int64).view(np.uint64)
    return np.cumsum(np.concatenate([start, *moved])[:n], dtype=np.uint64).view(np.int64)


def width_of(most: int) -> int:
    return int(most).bit_length()


def page(values: list, version: int) -> bytes:
    """A data page's body of an optional long column: definition levels, then the values that are there in eight bytes each.
    Version 1 has the levels' length before them; version 2 says it in its header, here in four bytes of the same kind."""
    there = np.array([v is not None for v in values], np.int64)
    levels = hybrid(there, 1)
    own = np.array([v for v in values if v is not None], "<i8").tobytes()
    return prefixed(levels) + own if version == 1 else struct.pack("<I", len(levels)) + levels + own


def unpage(data: bytes, n: int) -> list:
    (size,) = struct.unpack_from("<I", data)
    there = unhybrid(data[4 : 4 + size], 1, n)
    own = iter(np.frombuffer(data[4 + size :], "<i8").tolist())
    return [next(own) if x else None for x in there.tolist()]


def _dictionary_indices(values: np.ndarray) -> bytes:
    w = width_of(values.max(initial=0))
    return bytes([w]) + hybrid(values, w)


#: Kinds of payloads of longs without nulls: from values, and back from bytes and a count. The width stands before the bits.
KINDS = {
    "bits": (lambda v: bytes([w := width_of(v.max(initial=0))]) + packed(v, w), lambda b, n: unpacked(b[1:], b[0], n)),
    "hybrid": (_dictionary_indices, lambda b, n: unhybrid(b[1:], b[0], n)),
    "levels": (lambda v: bytes([w := width_of(v.max(initial=0))]) + prefixed(hybrid(v, w)), lambda b, n: unhybrid(b[5 : 5 + struct.unpack_from("<I", b, 1)[0]], b[0], n)),
    "delta": (delta, lambda b, n: undelta(b)),
    "plain": (lambda v: v.astype("<i8").tobytes(), lambda b, n: np.frombuffer(b, "<i8")),
}


def _lists(df: DataFrame) -> DataFrame:
    """(rg, n, values): a chunk's values in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col("value").alias("v"))))
    return df.groupBy("rg").agg(F.count("*").alias("n"), F.transform(ordered, lambda x: x["v"]).alias("values"))


def _mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """Each row's (rg, n, third column) through f, which gives the third column's values of the new row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rg, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict(f(rg, n, x))

    return df.mapInArrow(run, schema)


def encoded(df: DataFrame, kind: str) -> DataFrame:
    """(rg, n, payload) of each chunk's values that are not null: longs, not negative but for deltas and plain values."""
    encode = KINDS[kind][0]
    make = lambda rg, n, x: {"rg": pa.array([rg], pa.int64()), "n": pa.array([n], pa.int64()), "payload": pa.array([encode(np.array(x, np.int64))], pa.binary())}
    return _mapped(_lists(df.where("value is not null")), make, "rg bigint, n bigint, payload binary")


def decoded(payloads: DataFrame, kind: str) -> DataFrame:
    """(rg, i, value) from encoded(): values by their place among those that are not null."""
    decode = KINDS[kind][1]

    def make(rg, n, x):
        values = decode(bytes(x), n)
        return {"rg": pa.array([rg] * n, pa.int64()), "i": pa.array(range(n), pa.int64()), "value": pa.array(values, pa.int64())}

    return _mapped(payloads.select("rg", "n", "payload"), make, "rg bigint, i bigint, value bigint")


def pages(df: DataFrame, version: int = 1) -> DataFrame:
    """(rg, n, payload): a page's body of each chunk, nulls as levels."""
    make = lambda rg, n, x: {"rg": pa.array([rg], pa.int64()), "n": pa.array([n], pa.int64()), "payload": pa.array([page(x, version)], pa.binary())}
    return _mapped(_lists(df), make, "rg bigint, n bigint, payload binary")


def page_values(payloads: DataFrame) -> DataFrame:
    """(rg, i, value) from pages(), nulls too."""
    make = lambda rg, n, x: {"rg": pa.array([rg] * n, pa.int64()), "i": pa.array(range(n), pa.int64()), "value": pa.array(unpage(bytes(x), n), pa.int64())}
    return _mapped(payloads.select("rg", "n", "payload"), make, "rg bigint, i bigint, value bigint")
