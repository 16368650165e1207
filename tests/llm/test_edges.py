"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: a defined result, never a crash."""

import public_tokenizers
import pytest
from conftest import DATA

from shalegrid.llm import byte_bpe, common, decontam, html_extract, line_dedup, pii, quality_bayes, quality_rules, secret_links, simhash_dedup, token_counts

LONG = "alpha beta gamma delta epsilon zeta. " * 30_000
ROWS = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, "same text here for all of us"), (6, "same text here for all of us"), (6, "same text here for all of us"), (None, "no id but text"), (None, None), (7, "𝒳 é 日本 \x00 end")]
EXTRA = "source string, lang string, n_chars bigint, fp string, component_id string, key string, units string, n_tokens string, rank string, spans string, found string, __t string, kept string, n string"


def table(spark, rows):
    filler = ["x"] * 2 + [9] + ["x"] * 11
    return spark.createDataFrame([(i, t, *filler) for i, t in rows], f"doc_id bigint, text string, {EXTRA}")


def labels(spark, rows=((1, 0, 0), (4, 1, 0), (5, 1, 1), (5, 0, 1), (6, None, None), (None, 1, 1))):
    return spark.createDataFrame([*rows], "doc_id bigint, quality int, toxic int")


def benchmark(spark, rows=((1, "alpha beta gamma delta epsilon zeta alpha beta"), (2, None), (3, ""), (None, "no id but text"))):
    return spark.createDataFrame([*rows], "item_id bigint, text string")


def bayes(spark, docs):
    return quality_bayes.classify(docs, quality_bayes.train(docs, labels(spark)))


OPERATORS = {
    "op1": lambda s, d: decontam.contaminated(d, benchmark(s)),
    "op2": lambda s, d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
    "op3": lambda s, d: byte_bpe.digests(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    "op4": lambda s, d: line_dedup.remove_repeats(d),
    "op5": lambda s, d: pii.pseudonymize(d, b"key"),
    "op7": lambda s, d: simhash_dedup.near_duplicates(d),
    "op8": lambda s, d: secret_links.digests(d),
    "op9": bayes,
    "op10": lambda s, d: quality_rules.score(d, quality_rules.train(d, labels(s))),
    "keep_good": lambda s, d: quality_rules.keep_good(d, quality_rules.train(d, labels(s))),
    "keep_first": lambda s, d: simhash_dedup.keep_first(d),
    "keep_clean": lambda s, d: decontam.keep_clean(d, benchmark(s)),
    "redact": lambda s, d: secret_links.redact(d),
}
EACH_ROW = {"op2", "op3", "op4", "op5", "op7", "op8", "op9", "op10", "redact"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    got = OPERATORS[name](spark, table(spark, ROWS)).collect()
    if name in EACH_ROW:
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in ROWS)
    if name == "op1":
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(4, 1), (None, None)}
    if name == "keep_clean":
        assert len(got) == len(ROWS) - 2
    if name == "keep_first":  # ids 1, 2, 3 and the null share fingerprint zero; 5 and 6 a text
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [(False, 1), (False, 4), (False, 5), (False, 7), (True, 0)]
    if name == "op7":
        by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]}
        assert by == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    if name == "op2":
        by = {r["doc_id"]: r for r in got}
        assert (by[1]["n_bytes"], by[1]["n_tokens"], by[2]["n_tokens"], by[4]["over_limit"]) == (0, 0, 0, True)
    if name in ("keep_good", "keep_first", "keep_clean", "redact") and got:
        assert got[0].asDict().keys() == set(table(spark, []).columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).collect() == []


def test_pages_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>"), (4, "u", "<article><p>A &amp; b</p></article>"), (4, "u", "<article><p>A &amp; b</p></article>"), (None, None, "plain"), (5, "u", "<" * 5000), (6, "u", "<a '" * 3000)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as text", "1 as n_chars")).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got)[:6] == [(0, "plain"), (1, ""), (2, ""), (3, ""), (4, "A & b"), (4, "A & b")]
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.main_text(empty).collect() == []


def test_no_benchmark_no_labels(spark):
    docs = table(spark, ROWS)
    assert decontam.contaminated(docs, benchmark(spark, [])).collect() == []
    assert quality_rules.score(docs, quality_rules.train(docs, labels(spark, []))).count() == len(ROWS)
    assert quality_bayes.classify(docs, quality_bayes.train(docs, labels(spark, []))).count() == len(ROWS)


def test_every_query_runs(spark):
    from shalegrid.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, f"{DATA}/sf0.001").count() > 0, name


def test_arrow_batches_are_bounded(spark):
    held = spark.conf.get(common.BATCH, None)
    spark.conf.unset(common.BATCH)
    try:
        docs = spark.range(3).selectExpr("id as doc_id", f"repeat('x', {common.PORTION}) as text").coalesce(1)
        got = common.map_rows(docs, ["doc_id", "text"], lambda: lambda c: [[len(c[0])] * len(c[0]), [len(t) for t in c[1]]], common.fields("n bigint, size bigint")).collect()
        assert spark.conf.get(common.BATCH) == str(common.PORTION)
        assert [(r["n"], r["size"]) for r in got] == [(1, common.PORTION)] * 3
        spark.conf.set(common.BATCH, "1048576")
        common.filter_rows(docs, ["doc_id"], lambda: lambda c: [True] * len(c[0]))
        assert spark.conf.get(common.BATCH) == "1048576"  # the session's own choice stands
    finally:
        spark.conf.set(common.BATCH, held) if held else spark.conf.unset(common.BATCH)
