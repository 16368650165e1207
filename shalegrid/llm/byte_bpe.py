"""Byte-level BPE encoding and decoding over Arrow batches.

Bytes are shown to the tokenizers library as printable characters; decoding reverses that table, so ids whose tokens split a
character give back exactly its bytes. The library gets every pair of tokens that makes a token, by rank, so its merges are
those of the ranks, but for one case: a pre-token that holds an overlap (two different pairs for one token that share a part)
is merged once more by the rank rule, whose ids count if they differ. Its pattern engine classes characters as the rank
files' usual library does; texts with a character that the engine used here classes differently are split by the library.

Nulls are empty texts, empty texts have no ids; equal rows and equal ids are each encoded; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from shalegrid.llm.common import fields, map_rows
from shalegrid.llm.pretoken import SPLIT, Classes, Memo, by_rank, byte_chars, char_bytes, overlaps, read_ranks, shown, tokenizer_of_ranks


class Codec:
    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.ranks, self.tok = ranks, tokenizer_of_ranks(ranks)
        self.unsure, show = ahocorasick.Automaton(), byte_chars()
        for x in overlaps(ranks):
            self.unsure.add_word("".join(map(show.__getitem__, x)), True)
        self.unsure.make_automaton()
        back = char_bytes()
        #: The bytes of each id, from the characters that the library's vocabulary has.
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in self.tok.get_vocab().items()}
        self.classes, self.memo = Classes(self.tok), Memo(lambda words: [self._packed(w) for w in words])

    def _packed(self, word: str) -> bytes:
        seen = shown(word)
        ids = [t.id for t in self.tok.model.tokenize(seen)]
        if len(self.unsure) and next(self.unsure.iter(seen), None):
            ids = by_rank(word.encode(), self.ranks)
        return array("I", ids).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids as unsigned 32-bit integers (little-endian on every machine that Spark runs on)."""
        if self.classes.agreed(text):
            words = SPLIT.findall(text)
        else:
            words = [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]
        return b"".join(map(self.memo.of(words).__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Each token's characters, end exclusive; a token that holds part of a character has that whole character."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        starts = ends - [len(self.bytes_of[i]) for i in ids]
        return [(int(char_of[a]), int(char_of[b - 1]) + 1) for a, b in zip(starts, ends, strict=True)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a rank file, built once in each worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", offsets: bool = False) -> DataFrame:
    """(id, ids array<int>[, starts, ends array<int>]) of each row."""

    def make():
        c = codec(path)

        def run(columns: list[list]) -> list[list]:
            ids = [c.encode(t or "") for t in columns[1]]
            if not offsets:
                return [columns[0], ids]
            spans = [c.offsets(t or "", x) for t, x in zip(columns[1], ids, strict=True)]
            return [columns[0], ids, [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans]]

        return run

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, [id_column, text_column], make, fields(f"`{id_column}` {kind}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets))


def decode(tokens: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, bytes binary) of each row of token ids; null ids give no bytes. Raises on an id that the vocabulary lacks."""

    def make():
        c = codec(path)
        return lambda columns: [columns[0], [c.decode_bytes(x or []) for x in columns[1]]]

    kind = tokens.schema[id_column].dataType.simpleString()
    return map_rows(tokens, [id_column, ids_column], make, fields(f"`{id_column}` {kind}, bytes binary"))


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, in one pass."""

    def make():
        c = codec(path)

        def run(columns: list[list]) -> list[list]:
            n, ids_sha, text_sha = [], [], []
            for t in columns[1]:
                packed = c.packed(t or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(c.decode_bytes(ids)).hexdigest())
            return [columns[0], n, ids_sha, text_sha]

        return run

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, [id_column, text_column], make, fields(f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"))
