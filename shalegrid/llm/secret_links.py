"""Secret scans with multipart credential linking, in DataFrame and SQL functions only.

Base kinds (assign, access, hex) are reported wherever their patterns match. Weak candidates - access identifiers, long
mixed runs that may be secrets, endpoints - are reported only where complementary parts stand together: an identifier with a
secret, or an endpoint with either. Parts are linked by an interval join within a scope: the same document, the same
paragraph (text between blank lines), not more than REACH characters apart. Since a part is reported when any complementary
one lies in reach, it is enough to join it with the nearest of each role on either side, which a sorted pass does without
emitting pairs.

Offsets are code points, ends exclusive. A null text is empty and has no spans. Equal rows are each returned; rows that
share a doc_id but not the text are scanned each for itself. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalegrid.llm.common import null_to_empty, small_enough, staged, unused

#: Fixed patterns of the base kinds, in listed order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the run from the first AKIA is the longest, so a shorter one cannot hide a match
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"  # a leftmost run begins where no such character stands before
#: Weak candidates: their pattern and role.
WEAK = {
    "ident": (r"""(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", "id"),
    "opaque": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", "secret"),
    "endpoint": (r"""(?i:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]{4,}""", "endpoint"),
}
#: What an opaque run must hold besides.
MIXED = ("[0-9]", "[a-z]", "[A-Z]")
ROLES = {"assign": "secret", "hex": "secret", "access": "id"} | {k: role for k, (_, role) in WEAK.items()}
ORDER = ["assign", "access", "hex", *WEAK]
#: Characters between linked parts, at most.
REACH = 400
BLOCK = 128


def _matches(text: Column, pattern: str, ok=None) -> Column:
    """array<struct<gap, len, ok>>: characters before each match since the last one, its characters, and whether it counts
    by ok(text). Pieces between matches and the matches alternate, so their lengths give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    return F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("len"), (F.lit(True) if ok is None else ok(h)).alias("ok")))


def _placed(lens: Column) -> Column:
    """The spans that count. Sums run over blocks of matches, so that a text with very many of them stays near linear."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, x: a + x["gap"] + x["len"])

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lens) - 1) / BLOCK).cast("int")), lambda b: F.slice(lens, b * BLOCK + 1, F.lit(BLOCK)))
    before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + total(b))))
    spans = F.flatten(
        F.transform(
            F.arrays_zip(blocks.alias("b"), F.slice(before, 1, F.size(blocks)).alias("o")),
            lambda z: F.transform(
                z["b"],
                lambda x, i: F.struct((z["o"] + total(F.slice(z["b"], 1, i)) + x["gap"]).alias("start"), (z["o"] + total(F.slice(z["b"], 1, i)) + x["gap"] + x["len"]).alias("end"), x["ok"].alias("ok")),
            ),
        )
    )
    return F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


NONE = "array<struct<start:int,end:int>>"
LENS = "array<struct<gap:int,len:int,ok:boolean>>"


def parts(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the row's text), spans of each kind in a column of its name, breaks (blank lines); no texts.

    A pattern is tried only on texts that hold what each of its matches must hold: a sign, a scheme, a long run.
    """
    text = F.col("__t")
    out = docs.select("doc_id", null_to_empty().alias("__t"))
    out = out.select("doc_id", "__t", (text.contains("=") | text.contains(":")).alias("__sign"), text.rlike(WEAK["opaque"][0]).alias("__run"))
    sign, run = F.col("__sign"), F.col("__run")
    tried = {
        "assign": (sign & text.rlike(ASSIGN), ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 6),
        "access": (text.contains("AKIA"), ACCESS, None),
        "hex": (run, HEX, None),
        "ident": (sign & text.rlike(WEAK["ident"][0]), WEAK["ident"][0], None),
        "opaque": (run, WEAK["opaque"][0], lambda h: reduce(lambda a, b: a & b, (h.rlike(p) for p in MIXED))),
        "endpoint": (text.contains("://"), WEAK["endpoint"][0], None),
    }
    out = out.select("doc_id", "__t", *(F.when(gate, _matches(text, p, ok)).otherwise(F.array().cast(LENS)).alias(f"__{k}") for k, (gate, p, ok) in tried.items()))
    some = reduce(lambda a, b: a | b, (F.size(f"__{k}") > 0 for k in WEAK))
    out = out.select(
        "doc_id",
        F.xxhash64("__t").alias("key"),
        *(F.when(F.size(f"__{k}") > 0, _placed(F.col(f"__{k}"))).otherwise(F.array().cast(NONE)).alias(k) for k in tried),
        F.when(some & text.contains("\n"), _matches(text, r"\n[ \t]*\n\s*")).otherwise(F.array().cast(LENS)).alias("__breaks"),
    )
    return out.select("doc_id", "key", *tried, F.when(F.size("__breaks") > 0, _placed(F.col("__breaks"))).otherwise(F.array().cast(NONE)).alias("breaks"))


def _tagged(column: str, **tags: str) -> Column:
    """The column's spans, each with the tags as further fields."""
    return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *(F.lit(v).alias(k) for k, v in tags.items())))


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, key, added): the weak candidates that have a complementary part in reach; rows without are absent."""
    kinds = [*ROLES]
    marks = F.concat(*(_tagged(k, kind=k, role=ROLES[k]) for k in kinds), _tagged("breaks", kind="break", role="break"))
    roles = [reduce(lambda a, b: a | b, (F.size(k) > 0 for k in kinds if ROLES[k] == r)) for r in ("id", "secret", "endpoint")]
    weak = reduce(lambda a, b: a | b, (F.size(k) > 0 for k in WEAK))
    several = sum((r.cast("int") for r in roles[1:]), roles[0].cast("int")) >= 2
    rows = found.where(weak & several).select("doc_id", "key", F.explode(marks).alias("m")).select("doc_id", "key", "m.*").distinct()
    # A mark's scope is the number of breaks that end at or before its start: a running count over one sorted pass.
    is_break = F.col("kind") == "break"
    order = Window.partitionBy("doc_id", "key").orderBy(F.when(is_break, F.col("end")).otherwise(F.col("start")), F.when(is_break, 0).otherwise(1))
    rows = rows.withColumn("scope", F.count_if(is_break).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(~is_break)
    scope = Window.partitionBy("doc_id", "key", "scope")
    back = scope.orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    ahead = scope.orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    near = []
    for role in ("id", "secret", "endpoint"):
        rows = rows.withColumn(f"b_{role}", F.max(F.when(F.col("role") == role, F.col("end"))).over(back)).withColumn(f"a_{role}", F.last(F.when(F.col("role") == role, F.col("start")), ignorenulls=True).over(ahead))
        close = (F.col("start") - F.col(f"b_{role}") <= reach) | (F.col(f"a_{role}") - F.col("end") <= reach)
        near.append((F.col("role") != role) & F.coalesce(close, F.lit(False)))
    hit = rows.where(F.col("kind").isin([*WEAK]) & reduce(lambda a, b: a | b, near))
    return hit.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))


def _ranked(column: Column) -> Column:
    """Sorted by start, then kind as listed."""
    place = F.create_map(*(x for i, k in enumerate(ORDER) for x in (F.lit(k), F.lit(i))))
    return F.array_sort(F.transform(column, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("n"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, key, n_assign, n_access, n_hex, base, spans) of each row; base and spans are sorted arrays of
    (start, n, end, kind), spans with the linked candidates added."""
    found = staged(parts(docs), "parts")
    base = F.concat(*(_tagged(k, kind=k) for k in ("assign", "access", "hex")))
    more = linked(found, reach).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "added")
    both = found.join(more, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return both.select(
        "doc_id", "key", *(F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        _ranked(base).alias("base"), _ranked(F.concat(base, F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:string>>")))).alias("spans"),
    )


def digests(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) with kind:start:end texts."""
    return scan(docs, reach).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each run of overlapping spans replaced by the mask."""
    left = F.aggregate(
        spans,
        F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.when(s["start"] >= a["at"], F.concat(a["pieces"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"])))).otherwise(a["pieces"]).alias("pieces"),
            F.greatest(a["at"], s["end"]).alias("at"),
        ),
        lambda a: F.concat(a["pieces"], F.array(F.substring(text, a["at"] + 1, F.length(text)))),
    )
    return F.array_join(left, mask)


def redact(docs: DataFrame, mask: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs, all columns and rows kept, with the text of every span replaced by the mask and n_chars set anew.

    Null texts stay null, texts without spans as they are, whatever their ids; equal rows are each returned; an empty table
    gives no rows. A column n_chars of docs follows the text, others may have any names.
    """
    own_id, own_key, own_spans = unused(docs, "id", "key", "spans")
    places = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    hits = scan(docs, reach).where(F.size("spans") > 0).select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), places.alias(own_spans)).dropDuplicates([own_id, own_key])
    hits = staged(hits, "hits")
    right = F.broadcast(hits) if small_enough(hits) else hits
    both = docs.join(right, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(null_to_empty()) == F.col(own_key)), "left")
    text = F.when(F.size(own_spans) > 0, masked(F.col("text"), F.col(own_spans), mask)).otherwise(F.col("text"))
    both = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.size(own_spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return both.select(*docs.columns)
