"""Substring dedup by hashed units: the earliest ranked copy of a line or sentence stays, later ones go.

A unit is a line, or a sentence of it where a line holds several, so that a passage in the midst of a line is found too.
Units are normalised (lower case, words only) and digested to 96 bits; digests are grouped globally. A unit's rank is the
order of doc_id, then its place. Every unit that an earlier copy exists of is removed, with the white space behind it.
Whole lines are compared if they have a word, sentences inside a line from UNIT_WORDS words on; up to UNIT_WORDS - 1 words
between two removed spans go with them, unless they are a line of their own. Offsets are code points of the original text,
ends exclusive.

So that a copied passage is found whatever the lines and sentences around it, stretches of GRAM words are units too: of every
GRAM neighbouring stretches of a text the one with the least hash (winnowing), so that two documents with 2 * GRAM - 1 words
in common have chosen the same stretches there, without gaps between them. At most GRAM - 1 words at either end of such a
passage stay. A stretch that a text repeats goes where it does not overlap the first one.

Units are found once and shuffled once, by digest; a digest that many documents have is dealt over SALTS groups, whose least
ranks are then brought together. Which digests those are is looked up in a sample of documents: it decides where rows go,
never what is removed.

Null texts have no units. A null doc_id ranks last. Rows that share a doc_id rank by a hash of their texts (62 bits); of rows
equal in both, one counts as the earliest and the others are removed whole. Each row is returned. An empty table gives no
rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import struct
from array import array
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shalegrid.llm.common import fields, lowered, map_rows, staged

UNIT_WORDS, GRAM = 3, 20
END = re.compile(r"[.!?]+(?=[ \t])|\n")
WORD, BETWEEN, MARKS = re.compile(r"\w+"), re.compile(r"(\W+)"), re.compile(r"[^\w\s]*")
LAST = (1 << 63) - 1
#: Documents looked at for digests that many have, about; the documents among them that make a digest one of those; the
#: groups over which its rows are dealt; the rows of equal documents that one task writes.
LOOKED, OFTEN, SALTS, EQUAL = 10_000, 8, 64, 10_000
#: A repeated id's rank: the id (null: 2^63), then 62 bits of the text's hash. Decimals, since aggregates hold them in place.
TIED = f"coalesce(cast(doc_id as decimal(19,0)), {LAST + 1}BD) * {1 << 62}BD + cast(coalesce(xxhash64(text), 0L) & {(1 << 62) - 1}L as decimal(19,0))"


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


#: 64-bit hashes of words, remembered.
HASH: dict[str, int] = {}


def _hashes(words: list[str]) -> np.ndarray:
    if len(HASH) > 1 << 18:
        HASH.clear()
    known = list(map(HASH.get, words))
    if None in known:
        HASH.update((w, xxhash.xxh3_64_intdigest(w)) for w, h in zip(words, known, strict=True) if h is None)
        known = [HASH[w] for w in words]
    return np.frombuffer(array("Q", known), np.uint64)


def _digest(words: list[str]) -> tuple[int, int]:
    """The first 96 bits of a digest, as a long and an int."""
    return struct.unpack(">qi4x", xxhash.xxh3_128_digest(" ".join(words)))


def chosen(words: list[str], gram: int = GRAM) -> list[int]:
    """Places where a chosen stretch of gram words begins: the first least hash of every gram neighbouring stretches."""
    if len(words) < gram:
        return []
    h, width = _hashes(words), 1
    tail, spread = h, np.uint64(0x9E3779B97F4A7C15)
    for bit in f"{gram:b}"[1:]:
        power = np.uint64(pow(int(spread), width, 1 << 64))
        h, width = h[:-width] * power + h[width:], 2 * width
        if bit == "1":
            h, width = h[:-1] * spread + tail[width:], width + 1
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64((1 << 32) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    reach, width = min(gram, len(h)), 1
    while width < reach:
        step = min(width, reach - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    least = (least & low).astype(np.int64)
    return least[np.flatnonzero(np.diff(least, prepend=-1))].tolist()


def units(text: str) -> list[tuple[int, int, int, tuple[int, int] | None]]:
    """(start, end, words, digest, None if too short) of each unit, in order; a stretch has no words."""
    out, at, low = [], 0, lowered(text)
    parts = BETWEEN.split(low)
    first, last = int(not parts[0]), len(parts) - (not parts[-1])
    places = list(accumulate(map(len, parts), initial=0))
    every, starts, stops = parts[2 * first : last : 2], places[2 * first : last : 2], places[2 * first + 1 : last + 1 : 2]
    ends = [(m.end() - (text[m.start()] == "\n"), m.end()) for m in END.finditer(text)]
    fresh, i = True, 0  # whether a line begins here
    for end, after in [*ends, (len(text), len(text))]:
        while at < end and text[at].isspace():
            at += 1
        if at < end:
            j = bisect_left(starts, end, i)
            whole = fresh and not text[end : _line_end(text, end)].strip()
            out.append((at, end, j - i, _digest(every[i:j]) if j - i >= (1 if whole else UNIT_WORDS) else None))
            fresh, i = False, j
        fresh = fresh or after > end
        at = after
    for k in chosen(every):
        end = stops[k + GRAM - 1]
        if end < len(text) and not text[end].isspace():
            end = MARKS.match(low, end).end()
        out.append((starts[k], end, 0, _digest(every[k : k + GRAM])))
    out.sort()
    return out


def joined(text: str, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The removed spans as runs: what stands between two of them goes too if it is short and no line of its own."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(gone):
        if out:
            at, before = out[-1]
            between = text[before:start]
            if start <= before or (len(WORD.findall(between)) < UNIT_WORDS and not any(WORD.search(x) for x in between.split("\n")[1:-1])):
                out[-1] = (at, max(end, before))
                continue
        out.append((start, end))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans and the white space behind each."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
        while at < len(text) and text[at].isspace():
            at += 1
    return "".join([*parts, text[at:]])


def ranked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rank, n): a rank for each document; where ids repeat, equal rows are one row here and n counts them."""
    rank = F.coalesce("doc_id", F.lit(LAST))
    if not docs.groupBy(rank.alias("rank")).count().where("count > 1").limit(1).count():
        return docs.select("doc_id", "text", rank.alias("rank"), F.lit(1).cast("bigint").alias("n"))
    equal = docs.groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    return equal.select("doc_id", "text", F.expr(TIED).cast("decimal(38,0)").alias("rank"), F.col("n").alias("n", metadata={"repeats": True}))


def hashed_units(rows: DataFrame) -> DataFrame:
    """(rank, hi, lo, span, own) of each unit: its digest, its place (start << 32 | end), whether the text has it before."""

    def make():
        def run(columns: list[list]) -> list[list]:
            ranks, his, los, spans, own = [], [], [], [], []
            for rank, text in zip(*columns, strict=True):
                first: dict = {}
                for start, end, _, digest in units(text or ""):
                    if digest is not None:
                        ranks.append(rank)
                        his.append(digest[0])
                        los.append(digest[1])
                        spans.append(start << 32 | end)
                        own.append(start >= first.setdefault(digest, end))
            return [ranks, his, los, spans, own]

        return run

    kind = rows.schema["rank"].dataType.simpleString()
    return map_rows(rows, ["rank", "text"], make, fields(f"rank {kind}, hi bigint, lo int, span bigint, own boolean"))


def frequent(rows: DataFrame) -> DataFrame:
    """(hi, lo): digests that many documents have, as far as a sample shows. A digest needs OFTEN of about LOOKED documents, so
    there are at most as many as the sampled documents' units in OFTEN."""
    parts = max(1, rows.count() // LOOKED)
    some = rows.where(F.pmod(F.xxhash64("rank"), F.lit(parts)) == 0)
    return staged(hashed_units(some).where("not own").groupBy("hi", "lo").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select("hi", "lo"), "frequent")


def copied_units(rows: DataFrame) -> DataFrame:
    """(rank, gone array<bigint>): the places of units that a document of lower rank, or the text before them, has too."""
    often = frequent(rows).select(F.col("hi").alias("__hi"), F.col("lo").alias("__lo"), F.lit(True).alias("often"))
    made = hashed_units(rows).join(F.broadcast(often), (F.col("hi") == F.col("__hi")) & (F.col("lo") == F.col("__lo")), "left").drop("__hi", "__lo")
    made = made.withColumn("often", F.coalesce("often", F.lit(False))).withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("rank"), F.lit(SALTS)).cast("int")).otherwise(0))
    least = F.min("rank").over(Window.partitionBy("hi", "lo", "salt"))
    found = staged(made.withColumn("least", least).where("often or own or rank > least").drop("salt"), "copies")
    heads = found.where("often").groupBy("hi", "lo").agg(F.min("least").alias("first"))  # as few as frequent() gives
    rest = found.where("often").drop("least").join(F.broadcast(heads), ["hi", "lo"]).where("own or rank > first")
    later = found.where("not often").select("rank", "span").unionByName(rest.select("rank", "span"))
    return later.groupBy("rank").agg(F.collect_list("span").alias("gone"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed_words, removed spans, text that stays) of each row."""
    rows = ranked(docs)
    both = rows.join(copied_units(rows), "rank", "left")
    if rows.schema["n"].metadata.get("repeats"):
        # A row with very many equal ones is written by many tasks.
        both = both.selectExpr("*", f"explode(sequence(0L, (n - 1) div {EQUAL})) as part").repartition("rank", "part")
        both = both.selectExpr("doc_id", "text", "gone", f"explode(sequence(part * {EQUAL} + 1, least(n, (part + 1) * {EQUAL}))) as nth")
    else:
        both = both.selectExpr("doc_id", "text", "gone", "n as nth")

    def make():
        def run(columns: list[list]) -> list[list]:
            removed, spans, texts = [], [], []
            for text, gone, nth in zip(*columns[1:], strict=True):
                cut = joined(text or "", [(x >> 32, x & 0xFFFFFFFF) for x in gone or ()])
                if nth > 1 and WORD.search(text or ""):
                    cut = [(0, len(text))]
                removed.append(sum(len(WORD.findall(text, a, b)) for a, b in cut))
                spans.append([{"start": a, "end": b} for a, b in cut])
                texts.append(None if text is None else without(text, cut))
            return [columns[0], removed, spans, texts]

        return run

    return map_rows(both, ["doc_id", "text", "gone", "nth"], make, fields("doc_id bigint, n_removed_words bigint, removed array<struct<start:bigint,end:bigint>>, text string"))
