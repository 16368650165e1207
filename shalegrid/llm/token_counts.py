"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A huge document is encoded in overlapping chunks with character offsets. Two neighbouring chunks are spliced at a boundary
that both encodings have and that is stable: a place where no pre-token can reach across, whatever stands further left or
right (a non-space before white space, a letter before what is no letter, a digit before what is no digit). If the overlap
holds no such place, it is widened, at last to the whole of the two chunks.

Nulls count as empty texts, empty texts have no tokens; repeated rows and rows with equal ids are counted each for itself;
other columns of the input are not read.
"""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from shalegrid.llm.common import fields, map_rows
from shalegrid.llm.pretoken import SPLIT, Classes, Memo, shown

STABLE = regex.compile(r"(?<=\S)(?=[ \n])|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])")
#: Characters of a chunk and of the overlap that is tried first; a text of up to one chunk is encoded at once.
CHUNK, OVERLAP = 1 << 16, 1 << 9


class Encoded:
    """One chunk's tokens, with offsets in the whole text."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        e = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, e.ids
        self.starts = [start + a for a, _ in e.offsets]
        self.ends = [start + b for _, b in e.offsets]

    def cut(self, at: int) -> int | None:
        """How many tokens stand before character `at`, if a token ends and the next begins there."""
        from bisect import bisect_left

        k = bisect_left(self.starts, at)
        return k if k < len(self.starts) and self.starts[k] == at and (k == 0 or self.ends[k - 1] == at) else None


def splice(tokenizer, classes: Classes, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], int, int]:
    """(ids of the whole text, chunks encoded, times that an overlap was widened)."""
    left, first, out, chunks, widened = Encoded(tokenizer, text, 0, min(chunk, len(text))), 0, [], 1, 0
    while left.end < len(text):
        width = overlap
        while True:
            begin = left.end - width
            if begin <= left.start:  # the chunk has no stable place: it is encoded again, larger
                left, chunks = Encoded(tokenizer, text, left.start, min(len(text), left.end + max(chunk, left.end - left.start))), chunks + 1
                break
            right, chunks = Encoded(tokenizer, text, begin, min(len(text), begin + max(chunk, 2 * width))), chunks + 1
            common = None
            for m in STABLE.finditer(text, begin + 1, left.end - 1):
                b = m.start()
                if classes.agreed(text[b - 1 : b + 1]) and (k := left.cut(b)) is not None and k >= first and (r := right.cut(b)) is not None:
                    common = k, r
                    break
            if common:
                out += left.ids[first : common[0]]
                left, first = right, common[1]
                break
            width, widened = 2 * width, widened + 1
    return out + left.ids[first:], chunks, widened


class Counter:
    """Counts of a byte-level tokenizer by distinct pre-tokens; of any other one by whole texts."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        from tokenizers import Tokenizer

        self.tok, self.chunk, self.overlap = Tokenizer.from_file(path), chunk, overlap
        self.tok.no_truncation()
        self.tok.no_padding()
        pre = self.tok.pre_tokenizer
        self.bytelevel = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.tok.normalizer is None and self.tok.post_processor is None
        self.classes = Classes(self.tok) if self.bytelevel else None
        self.added = [x.content for x in self.tok.get_added_tokens_decoder().values()]
        model = self.tok.model
        self.memo = Memo(lambda words: [len(model.tokenize(shown(w))) for w in words])

    def __call__(self, texts: list[str]) -> list[int]:
        out, whole = [0] * len(texts), []
        for i, t in enumerate(texts):
            if self.bytelevel and len(t) > self.chunk:
                out[i] = len(splice(self.tok, self.classes, t, self.chunk, self.overlap)[0])
            elif not self.bytelevel or any(a in t for a in self.added) or not self.classes.agreed(t):
                whole.append(i)
            else:
                words = SPLIT.findall(t)
                out[i] = sum(map(self.memo.of(words).__getitem__, words))
        for i, e in zip(whole, self.tok.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = len(e)
        return out


class PieceCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=4)
def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """The counter for a vocabulary file, built once in each worker: tokenizers for .json, sentencepiece for .model."""
    return PieceCounter(path) if path.endswith(".model") else Counter(path, chunk, overlap)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row."""

    def make():
        count = counter(path)

        def run(columns: list[list]) -> list[list]:
            ids, texts = columns[0], [t or "" for t in columns[1]]
            n = count(texts)
            return [ids, [len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return run

    kind = docs.schema[id_column].dataType.simpleString()
    return map_rows(docs, [id_column, text_column], make, fields(f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"))
