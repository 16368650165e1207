"""AES-GCM of column values, with associated data that names the module."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of encrypted modules; fixed values.
MODULES = {"footer": 0, "column_metadata": 1, "data_page": 2, "dictionary_page": 3, "data_page_header": 4, "dictionary_page_header": 5, "column_index": 6, "offset_index": 7, "bloom_header": 8, "bloom_bitset": 9}


def module_aad(module: str, row_group: int | None = None, column: int | None = None, page: int | None = None) -> bytes:
    """The module's byte, then the ordinals that are given, two little-endian bytes each."""
    return bytes([MODULES[module]]) + b"".join(struct.pack("<h", x) for x in (row_group, column, page) if x is not None)


def encrypt(x: Column, key: bytes, aad: bytes = b"") -> Column:
    """iv, ciphertext and tag. The iv is random, so equal values do not show."""
    return F.aes_encrypt(x, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad))


def decrypt(x: Column, key: bytes, aad: bytes = b"") -> Column:
    """The value; an error for a wrong key, wrong associated data or altered bytes."""
    return F.aes_decrypt(x, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))


def try_decrypt(x: Column, key: bytes, aad: bytes = b"") -> Column:
    """The value, or null where decrypt() would fail."""
    return F.try_aes_decrypt(x, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad))
