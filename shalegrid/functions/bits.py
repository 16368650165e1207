"""Bit arithmetic of column encodings, as expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_width(x: Column) -> Column:
    """Bits that a non-negative value needs; zero needs none."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x))).cast("long")


def zigzag(x: Column) -> Column:
    """Signed to unsigned, small magnitudes first. Bitwise, so that no value of a long overflows."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1)))


def uleb_length(x: Column) -> Column:
    """Bytes of x as an unsigned varint of seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("long")


def plain_bytes(x: Column, kind: str) -> Column:
    """Bytes of a value in plain encoding: its width, or four and its length for strings and binaries. Null takes none."""
    width = {"int": 4, "float": 4, "bigint": 8, "double": 8, "timestamp_ntz": 8, "timestamp": 8, "date": 4}.get(kind)
    size = F.lit(width) if width else F.octet_length(x) + 4
    return F.when(x.isNotNull(), size).otherwise(0).cast("long")


def little_endian(x: Column, width: int) -> Column:
    """The value's bytes, the least first."""
    return F.reverse(F.unhex(F.lpad(F.hex(x), 2 * width, "0")).cast("binary"))
