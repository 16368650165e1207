"""Checksums and hashes of single values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def crc32(x: Column) -> Column:
    """CRC-32 (polynomial 0xEDB88320) of a string's or binary's bytes."""
    return F.crc32(x)


def xxhash64(x: Column) -> Column:
    """XXH64 with seed 42, the one that runs in generated code."""
    return F.xxhash64(x)


def xxhash64_of_seed(x: Column, seed: int = 0) -> Column:
    """XXH64 of a value's plain bytes (UTF-8, or little-endian) with any seed, as a signed long; null gives null."""

    @F.pandas_udf("bigint")
    def hashed(values: pd.Series) -> pd.Series:
        import xxhash

        digests = (None if v is None else xxhash.xxh64_intdigest(bytes(v), seed) for v in values)
        return pd.Series([None if h is None else h - (1 << 64) if h >> 63 else h for h in digests], dtype="object")

    return hashed(x.cast("binary"))
