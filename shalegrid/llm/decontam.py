"""Benchmark decontamination: SimHash windows of an item's size, multi-index Hamming blocks, exact similarity.

A window of a document has as many words as an item. Windows and items get SimHash fingerprints of BITS bits from their
five-word shingles, weighted by how often they occur. Sixteen blocks of 16 bits index the items of a length: fingerprints
within RADIUS bits agree within three bits in one block at least, so items are filed under each block's value and those one
bit away, and a window looks up its values and those up to two bits away. Only pairs that meet there are held against the
true distance, and what lies within RADIUS is verified: shared weight over total weight (the sum of lesser over the sum of
greater counts) must reach the threshold. At a similarity of 0.8 the expected distance is 39 bits with a deviation of 5.7,
so RADIUS stands four deviations away; tests measure what that misses.

A window is formed only where so many of its shingles occur in items of its length as the threshold needs of a pair; every
window above the threshold has them. Items come in blocks of bounded size, each block one pass over all documents.

Words are runs of letters, digits and underscores in lower case. Items of fewer than five words are one shingle; items
without words, and null texts on either side, never match. Repeated rows and ids each give their rows; a pair of row and
item gives one row, its best window (of ties the first). Columns besides doc_id, item_id and text are not read; an empty
table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalegrid.llm.common import fields, filter_rows, lowered, map_rows, staged, union_all

WORDS, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, of a block, that an item is filed away from its block's value, that a window looks further.
BITS, BLOCK, FILED, LOOKED = 256, 16, 1, 2
#: By the pigeonhole principle the greatest distance at which one block differs by FILED + LOOKED bits at most.
RADIUS = (FILED + LOOKED + 1) * (BITS // BLOCK) - 1
#: Items and bytes of items that one pass sends to the executors, about; windows that are looked up at once.
BLOCK_ITEMS, BLOCK_BYTES, AT_ONCE = 1 << 14, 1 << 25, 512
WORD = re.compile(r"\w+")


def shingles(words: list[str], size: int) -> list[str]:
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def similarity(a: Counter, b: Counter) -> float:
    both = a.keys() & b.keys()
    n, m = a.total(), b.total()
    shared = len(both) if n == len(a) or m == len(b) else sum(min(a[k], b[k]) for k in both)
    most = n + m - shared
    return shared / most if most else 0.0


def _signs(names: list[str]) -> np.ndarray:
    raw = b"".join(xxhash.xxh3_128_digest(s, seed) for s in names for seed in range(BITS // 128))
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _packed(totals: np.ndarray) -> np.ndarray:
    return np.packbits((totals > 0).astype(np.uint8), axis=1, bitorder="little").view("<u8")


def _flips(most: int) -> np.ndarray:
    """The values of a block with so many bits set at most."""
    every = np.arange(1 << BLOCK, dtype=np.int32)
    return every[np.bitwise_count(every) <= most]


def _keys(fps: np.ndarray, flips: np.ndarray) -> np.ndarray:
    """[row, block, flip]: the block's number and its value with the flip, as one number."""
    values = fps.view("<u2").astype(np.int32)
    return (values[:, :, None] ^ flips) + (np.arange(values.shape[1], dtype=np.int32) << BLOCK)[:, None]


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of the ranges that begin at starts, one range after another."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class Group:
    """Items of one length: fingerprints, and the items under each block's key."""

    def __init__(self, items: list[tuple], k: int):
        self.ids, self.shingles = [i for i, _ in items], [shingles(w, k) for _, w in items]
        self.fps = np.concatenate([_packed(_signs(s).sum(0, keepdims=True)) for s in self.shingles])
        keys = _keys(self.fps, _flips(FILED)).reshape(len(items), -1)
        order = np.argsort(keys, axis=None, kind="stable")
        self.filed = (order // keys.shape[1]).astype(np.int32)
        self.keys, self.first, self.count = np.unique(keys.ravel()[order], return_index=True, return_counts=True)
        self.counted: dict[int, Counter] = {}

    def counts(self, i: int) -> Counter:
        if i not in self.counted:
            self.counted[i] = Counter(self.shingles[i])
        return self.counted[i]

    def met(self, windows: np.ndarray) -> np.ndarray:
        """Rows (window, item) of the pairs that meet in a block, each once, in order."""
        looked = _flips(LOOKED)
        out = []
        for w in range(0, len(windows), AT_ONCE):
            asked = _keys(windows[w : w + AT_ONCE], looked).reshape(len(windows[w : w + AT_ONCE]), -1)
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            row, col = np.nonzero(self.keys[at] == asked)
            found = at[row, col]
            pairs = np.repeat(row + w, self.count[found]) * len(self.ids) + self.filed[_ranges(self.first[found], self.count[found])]
            out.append(np.unique(pairs))
        return np.stack(np.divmod(np.concatenate(out), len(self.ids)), 1)

    def within(self, windows: np.ndarray, radius: int) -> list[tuple[int, int, int]]:
        """(window, item, distance) of the pairs within the radius."""
        pairs = self.met(windows)
        apart = np.bitwise_count(windows[pairs[:, 0]] ^ self.fps[pairs[:, 1]]).sum(1)
        near = apart <= radius
        return list(zip(*pairs[near].T.tolist(), apart[near].tolist(), strict=True))


class Index:
    """One block of items: the shingles that tell where a window is worth forming, and a group for each length."""

    def __init__(self, items: list[tuple], size: int = WORDS, threshold: float = SIMILARITY, radius: int = RADIUS):
        if radius > RADIUS:
            raise ValueError(f"the blocks hold what lies within {RADIUS} bits")
        self.threshold, self.radius = threshold, radius
        self.vocabulary: dict[str, int] = {}
        by_length: dict[tuple[int, int], list] = {}
        for item_id, text in items:
            if words := WORD.findall(lowered(text or "")):
                by_length.setdefault((min(size, len(words)), len(words)), []).append((item_id, words))
                for w in words:
                    self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.groups = {key: Group(group, key[0]) for key, group in by_length.items()}
        #: By shingle size: hashes in order, and for each the lengths of the items that have it.
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in {k for k, _ in by_length}:
            hashes, lengths = [], []
            for (k2, length), group in by_length.items():
                for _, words in group if k2 == k else ():
                    made = self._hashed(np.array([self.vocabulary[w] for w in words], np.uint64), k)
                    hashes.append(made)
                    lengths.append(np.full(len(made), length))
            h, n = np.concatenate(hashes), np.concatenate(lengths)
            order = np.lexsort((n, h))
            h, n = h[order], n[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (n[1:] != n[:-1])])
            h, n = h[once], n[once]
            self.known[k] = (*np.unique(h, return_index=True, return_counts=True), n)

    @staticmethod
    def _hashed(ids: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k neighbouring ids from each place on."""
        h = np.zeros(len(ids) - k + 1, np.uint64)
        for j in range(k):
            h = (h ^ ids[j : len(h) + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def places(self, words: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """Window starts by (shingle size, window length) that have as many items' shingles as the threshold needs."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        out: dict[tuple[int, int], np.ndarray] = {}
        for k, (hashes, first, count, lengths) in self.known.items():
            if len(ids) < k:
                continue
            all_known = np.convolve(ids > 0, np.ones(k, int), "valid") == k if k > 1 else ids > 0
            at = np.flatnonzero(all_known)
            if not len(at):
                continue
            h = self._hashed(ids, k)[at]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[place] == h
            at, place = at[hit], place[hit]
            length_of = lengths[_ranges(first[place], count[place])]
            where = np.repeat(at, count[place])
            for length in np.unique(length_of).tolist():
                flags = np.zeros(len(ids) - k + 2, np.int32)
                flags[1:][where[length_of == length]] = 1
                sums, wide = np.cumsum(flags), min(length, len(words)) - k + 1
                need = ceil(self.threshold / (1 + self.threshold) * (wide + length - k + 1) - 1e-9)
                starts = np.flatnonzero(sums[wide:] - sums[: len(sums) - wide] >= max(1, need))
                if len(starts):
                    out[k, length] = starts
        return out

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, similarity, start, end, bits apart) of each item found, ends exclusive, in characters."""
        low = lowered(text or "")
        words = WORD.findall(low)
        best: dict = {}
        for (k, length), starts in self.places(words).items():
            group, wide = self.groups[k, length], min(length, len(words)) - k + 1
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > length) + 1):
                first = int(run[0])
                names = shingles(words[first : int(run[-1]) + wide + k - 1], k)
                sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_signs(names), 0, dtype=np.int32)])
                at = run - first
                counts: dict[int, Counter] = {}
                for w, i, apart in group.within(_packed(sums[at + wide] - sums[at]), self.radius):
                    if w not in counts:
                        counts = {w: Counter(names[at[w] : at[w] + wide])}
                    s, start = similarity(group.counts(i), counts[w]), int(run[w])
                    if s >= self.threshold and (s, -start) > best.get((k, length, i), (0, 0))[:2]:
                        best[k, length, i] = s, -start, apart
        if not best:
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        out = [(self.groups[k, length].ids[i], s, spans[-start][0], spans[min(len(spans), length - start) - 1][1], apart) for (k, length, i), (s, start, apart) in best.items()]
        return sorted(out, key=lambda m: (m[2], m[0] is None, m[0] or 0))


def indexes(benchmark: DataFrame, size: int = WORDS, threshold: float = SIMILARITY, radius: int = RADIUS):
    """The index of each block of items. Rows are dealt over blocks one by one, equal ones too, so that a block holds about
    BLOCK_ITEMS items or BLOCK_BYTES (or a single larger item)."""
    total = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-total["n"] // BLOCK_ITEMS), -(-total["bytes"] // BLOCK_BYTES))
    rows = benchmark.select("item_id", "text")
    if blocks > 1:
        rows = staged(rows.withColumn("__b", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")), "items")
    for b in range(blocks):
        one = (rows.where(F.col("__b") == b) if blocks > 1 else rows).select("item_id", "text").collect()
        yield Index(sorted(((r[0], r[1]) for r in one), key=str), size, threshold, radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start, end, bits) of each document and item that it holds."""
    out = fields("doc_id bigint, found array<struct<item_id:bigint,similarity:double,start:bigint,end:bigint,bits:int>>")
    spark, frames = docs.sparkSession, []
    for index in indexes(benchmark, size, threshold, radius):
        sent = spark.sparkContext.broadcast(index)

        def make(sent=sent):
            index = sent.value
            names = ("item_id", "similarity", "start", "end", "bits")
            return lambda columns: [columns[0], [[dict(zip(names, m, strict=True)) for m in index.matches(t)] for t in columns[1]]]

        frames.append(map_rows(docs, ["doc_id", "text"], make, out).where("size(found) > 0").selectExpr("doc_id", "inline(found)"))
    return union_all(frames)


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WORDS, threshold: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows, with all columns, that hold no item; so null and empty texts stay, and an empty table of items takes none."""
    for index in indexes(benchmark, size, threshold, radius):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def make(sent=sent):
            index = sent.value
            return lambda columns: [not index.matches(t) for t in columns[0]]

        docs = filter_rows(docs, ["text"], make)
    return docs
