"""SimHash near-duplicates: fingerprints, a grid range join over segment popcounts, exact verification, components.

A fingerprint's 64 bits make 16 segments of 4 bits; the packed popcounts of the segments are its cell. Flipping one bit moves
one segment's popcount by one, so fingerprints within Hamming distance 2 have cells within Manhattan distance 2, and two such
cells meet in a cell that lies within 1 of both. Each fingerprint therefore goes to its own cell and the cells next to it (33
at most), and an equi-join on the cell finds every pair within the bound once; the true distance is then checked.

A cell with more than CROWDED fingerprints is not joined with itself: its members are dealt anew by the exact fingerprints at
most one bit away from them. Both ways are exact; which one a cell takes never changes what is linked. Members that share such a midpoint are all within distance 2 of one another, and every pair within 2
shares one, so linking each to the least of them keeps all links, without pairs.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalegrid.llm.common import fields, joined, map_rows, sieve, sifted, staged, unstage, unused
from shalegrid.llm.components import connected_components

WORDS = 3
WORD = re.compile(r"\w+")
#: Fingerprints in a cell from which it is split by midpoints; less for those of words, whose copies crowd in few cells.
CROWDED, CROWDED_WORDS = 64, 16
#: Bits in which the shingle fingerprints of an edited copy may differ; of two texts that have nothing in common, they differ
#: so little once in four million pairs.
ALIKE = 12
#: Fingerprints that are sent to every task at most: those that each have one in HOT of all rows.
HOT = 1000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits of the shingles' XXH64 (seed 42). A-Z in lower case; words end at ASCII white space."""
    ws = (text or "").encode().lower().split()  # bytes.lower changes A-Z alone
    if not ws:
        return 0
    if len(ws) < words:
        shingles = [b" ".join(ws)]
    else:
        joined = b" ".join(ws)
        ends, at = [], -1
        for w in ws:
            at += len(w) + 1
            ends.append(at)
        shingles = [joined[a:b] for a, b in zip([0, *[e + 1 for e in ends]], ends[words - 1 :])]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, len(shingles), 65536):
        h = np.array([digest(s, 42) for s in shingles[k : k + 65536]], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * total > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp bigint: the 64 bits) of each row; null and empty texts have fingerprint zero."""

    def make():
        def run(columns: list[list]) -> list[list]:
            return [columns[0], [x - (1 << 64) if x >> 63 else x for x in (fingerprint(t, words) for t in columns[1])]]

        return run

    return map_rows(docs, ["doc_id", "text"], make, fields("doc_id bigint, fp bigint"))


def _cell(fp: str) -> str:
    """Popcounts of the 16 segments of four bits, packed four bits each, from half-adder pairs: nothing overflows."""
    shifted = f"shiftrightunsigned({fp}, 1)"
    pairs = f"((({fp} ^ {shifted}) & 6148914691236517205) | shiftleft({fp} & {shifted} & 6148914691236517205, 1))"
    return f"(({pairs} & 3689348814741910323) + (shiftrightunsigned({pairs}, 2) & 3689348814741910323))"


def _segment(cell: str, k: str) -> str:
    return f"(shiftrightunsigned({cell}, 4 * {k}) & 15)"


def links(classes: DataFrame, crowded: int = CROWDED, unique: bool = True) -> DataFrame:
    """(u, v) node pairs whose fingerprints differ in 2 bits at most, or enough of them to connect all such pairs.

    classes: (node, fp), one row for each node; unique: no two nodes have one fingerprint.
    """
    nodes = classes.count()
    own = classes.selectExpr("node", "fp", f"{_cell('fp')} as home")
    steps = "transform(sequence(0, 15), k -> struct(k as seg, 1 as move)), transform(sequence(0, 15), k -> struct(k as seg, -1 as move))"
    near = own.selectExpr("node", "fp", "home", f"explode(concat(array(struct(-1 as seg, 0 as move)), {steps})) as s").where(
        f"s.move = 0 or (s.move = 1 and {_segment('home', 's.seg')} < 4) or (s.move = -1 and {_segment('home', 's.seg')} > 0)"
    )
    unit = "shiftleft(15L, 4 * s.seg)"
    moved = f"(home & ~{unit}) | shiftleft({_segment('home', 's.seg')} + s.move, 4 * s.seg)"
    cells = near.selectExpr("node", "fp", f"case when s.move = 0 then home else {moved} end as cell", "cast(s.seg as byte) as seg", "cast(s.move as byte) as move")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(joined(cells, sizes, "cell", 33 * nodes), "cells")
    rows = shared.agg(F.count_if(F.col("n") <= crowded).alias("few"), F.count_if(F.col("n") > crowded).alias("many")).first()
    few, many = shared.where(F.col("n") <= crowded), shared.where(F.col("n") > crowded)
    # Of the cells in which two fingerprints meet, one is taken: by the moves that led there.
    a, b = (few.select(F.col("cell"), *(F.col(c).alias(f"{x}_{c}") for c in ("node", "fp", "seg", "move"))) for x in "ab")
    meets = "(a_move = 0 and b_move = 0 and a_node < b_node) or (a_move = 0 and b_move = 1) or (a_move = -1 and b_move = 1 and a_seg <= b_seg) or (a_move = 1 and b_move = 1 and a_seg < b_seg)"
    pairs = joined(a, b, "cell", rows["few"]).where(f"a_node <> b_node and ({meets}) and bit_count(a_fp ^ b_fp) <= 2").select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))
    dealt = many.select("node", "fp").distinct()
    if not unique:  # of nodes with one fingerprint the least stands for all
        heads = dealt.groupBy("fp").agg(F.min("node").alias("head"))
        same = joined(dealt, heads, "fp", min(nodes, rows["many"])).where("node <> head").select(F.col("head").alias("u"), F.col("node").alias("v"))
        dealt, pairs = heads.select(F.col("head").alias("node"), "fp"), pairs.unionByName(same)
    bits = dealt.selectExpr("node", "fp", "explode(sequence(-1, 63)) as bit").selectExpr("node", "case when bit < 0 then fp else fp ^ shiftleft(1L, bit) end as mid")
    least = bits.groupBy("mid").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1").select("mid", "u")
    stars = joined(bits, least, "mid", 65 * min(nodes, rows["many"])).where("node <> u").select("u", F.col("node").alias("v"))
    return pairs.unionByName(stars)


def _with_components(fps: DataFrame, crowded: int) -> DataFrame:
    """fps (fp, doc_id) with component_id."""
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "classes")
    # A node is its class's fingerprint, so that rows that share a doc_id but no text never fall together.
    nodes = classes.count()
    edges = links(classes.select(F.col("fp").alias("node"), "fp"), crowded)
    comps = staged(connected_components(edges), "components")
    ids = joined(comps, classes.select(F.col("fp").alias("node"), "doc_id"), "node", nodes)
    least = ids.groupBy("component").agg(F.min("doc_id").alias("least"))
    of_fp = joined(comps, least, "component", nodes).select(F.col("node").alias("fp"), "least")
    heads = staged(joined(classes, of_fp, "fp", nodes, "left").select("fp", "n", F.coalesce("least", "doc_id").alias("component_id")), "heads")
    unstage(classes, comps)
    # A fingerprint that many rows share would make one task of the join large. At most HOT fingerprints can have one in
    # HOT of all rows: those are sent to every task, and the rows of the others are dealt by fingerprint.
    rows = fps.count()
    hot = F.broadcast(heads.where(F.col("n") * HOT >= rows).drop("n"))
    often, rarely = fps.join(hot, "fp"), joined(fps.join(hot, "fp", "left_anti"), heads.where(F.col("n") * HOT < rows).drop("n"), "fp", nodes)
    return often.unionByName(rarely)


def near_duplicates(docs: DataFrame, words: int = WORDS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: least doc_id reachable) of each row.

    Links join fingerprints that differ in two bits or fewer, so null, empty and blank texts (fingerprint zero) link like any
    others. A null doc_id takes part with its text; where a component has null ids only, its component_id is null. Rows that
    repeat a doc_id are each returned; an empty table gives no rows.
    """
    known = _with_components(staged(fingerprints(docs, words), "fingerprints"), crowded)
    return known.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_fingerprints(text: str | None) -> tuple[int, int]:
    """Two independent fingerprints of the single words (letters, digits and underscores in lower case), weighted by how often
    they occur. Marks do not count: a table's bars would outweigh its words."""
    counts = Counter(WORD.findall((text or "").lower()))
    if not counts:
        return 0, 0
    bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, counts)), np.uint8).reshape(-1, 16), axis=1, bitorder="little")
    totals = np.fromiter(counts.values(), np.float64, len(counts)) @ bits
    a, b = np.packbits(2 * totals > counts.total(), bitorder="little").view("<u8").tolist()
    return a, b


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def copy_links(classes: DataFrame, crowded: int = CROWDED_WORDS) -> DataFrame:
    """(u, v) nodes of near copies: their shingle fingerprints link, or one of their word fingerprints does and the shingle
    fingerprints differ in ALIKE bits or fewer.

    classes: (node, fp, word_a, word_b), one row for each node. An edited copy keeps nearly all words but not nearly all
    shingles, so words find what shingles within two bits miss; the shingles then verify it.
    """
    nodes = classes.count()
    out = links(classes.select("node", "fp"), CROWDED, unique=False)
    for name in ("word_a", "word_b"):
        found = links(classes.select("node", F.col(name).alias("fp")), crowded, unique=False)
        for end in ("u", "v"):
            found = joined(found, classes.select(F.col("node").alias(end), F.col("fp").alias(f"fp_{end}")), end, nodes)
        out = out.unionByName(found.where(f"bit_count(fp_u ^ fp_v) <= {ALIKE}").select("u", "v"))
    return out


def keep_first(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of docs for each group of near copies (copy_links): that of its least doc_id, null last.

    A row is known by its doc_id and text, so rows that repeat an id or have none stay where their groups differ. Of a
    group's rows with one id, that with the least digest of the text stays; of rows equal in both, any one. Null texts
    count as empty ones. An empty table gives no rows; columns besides doc_id and text may have any names.
    """
    own_id, own_digest, own_text = unused(docs, "id", "digest", "text")
    digest = F.md5(F.coalesce("text", F.lit("")))

    def make():
        def run(columns: list[list]) -> list[list]:
            both = [word_fingerprints(t) for t in columns[1]]
            return [columns[0], [_signed(fingerprint(t, words)) for t in columns[1]], [_signed(a) for a, _ in both], [_signed(b) for _, b in both], columns[2]]

        return run

    kinds = "doc_id bigint, fp bigint, word_a bigint, word_b bigint, digest string"
    fps = staged(map_rows(docs.select("doc_id", "text", digest.alias("digest")), ["doc_id", "text", "digest"], make, fields(kinds)), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    classes = staged(fps.groupBy("fp", "word_a", "word_b").agg(least).withColumn("node", F.monotonically_increasing_id()), "classes")
    comps = staged(connected_components(copy_links(classes)), "components")
    grouped = joined(classes, comps, "node", comps.count(), "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("least").alias("least"))
    firsts = grouped.select(F.col("least.doc_id").alias(own_id), F.col("least.digest").alias(own_digest), F.lit(True).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col("digest") == F.col(own_digest))
    rows = fps.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    keys = staged(joined(rows, firsts, same, classes.count(), "left").select("doc_id", "digest", "n", F.col("first").isNotNull().alias("stays")), "keys")
    unstage(fps, classes, comps)
    # Texts are too large to shuffle. A sieve of the keys that go, or stay once though they repeat, parts the rows that stay as
    # they are from the others; of those, a sieve of the keys that stay and were held back leaves few, which are looked up.
    watched = keys.where("not stays or n > 1")
    n = watched.count()
    if not n:
        unstage(keys)
        return docs
    key = F.xxhash64(F.col("doc_id").cast("long"), "digest")
    goes = sieve(watched, key, n)
    held = staged(sifted(keys.where("stays"), key, goes, True).select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest), "n"), "held")
    counts = held.agg(F.count("*").alias("n"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    unstage(keys)
    known = docs.withColumn(own_text, digest)
    key = F.xxhash64(F.col("doc_id").cast("long"), own_text)
    kept = sifted(known, key, goes, False)
    if counts["n"]:
        same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(own_text) == F.col(own_digest))
        stay = sieve(held, F.xxhash64(own_id, own_digest), counts["n"])
        late = joined(sifted(sifted(known, key, goes, True), key, stay, True), held, same, counts["n"], "left_semi")
        kept = kept.union(late.dropDuplicates(["doc_id", own_text]) if counts["repeated"] else late)
    return kept.drop(own_text)
