"""Quality rules: hard base rules, then gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled documents (SAMPLE rows, those with the least hash of the id), from
statistics that executors compute; every document is then scored in one pass. More symbols, repeats or repeated lines can
only lower the verdict (monotonic constraints).

A null text has no words and fails the base rules; so does an empty one. Equal rows get equal verdicts. Labels that are null
or contradict each other for one id (mean 0.5) are not learned from; of rows that share a labelled id the one with the least
hash of its text is; without labels of both classes the base rules decide. An empty table gives no rows. Columns besides
doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalegrid.llm import gbt
from shalegrid.llm.common import fields, filter_rows, map_rows

#: Labelled documents that are learned from, at most.
SAMPLE = 20_000
#: The probability of good quality under which the trees reject. Low: a clean document should stay.
CUT = 0.2
SYMBOLS = [c.encode() for c in "#*$%&|<>"]
#: Statistic and sign: -1 where a larger value may only lower the quality.
FEATURES = {
    "symbols_per_word": -1, "duplicate_line_share": -1, "repeat_share": -1, "distinct_share": 0, "log_words": 0, "mean_word": 0,
    "words_per_line": 0, "longest_word": 0, "digit_share": 0, "punctuation_share": 0, "upper_share": 0, "top_word_share": -1,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen, twice = set(), set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in twice:
            covered[i : i + 3] = b"\1\1\1"
    return covered.count(1)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(the counts of COUNTS, the values of FEATURES)."""
    text = text or ""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII white space only
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    symbols, doubled, repeats = sum(map(raw.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)
    word_chars = len(text) - (len(raw) - chars)
    if not n:
        return [0, 0, symbols, 0, 0], [0.0] * len(FEATURES)
    distinct = set(words)
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    points = len(raw) - len(raw.translate(None, b".,;:!?"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    top = 0.0
    if len(distinct) < 0.8 * n:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        top = max(counts.values()) / n
    return [n, word_chars, symbols, doubled, repeats], [
        symbols / n, doubled / len(lines), repeats / n, len(distinct) / n, float(np.log1p(n)), word_chars / n,
        n / len(lines), float(max(map(len, distinct))), digits / chars, points / n, upper / n, top,
    ]


def labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs' text for each id of marks, with its columns: one row for each id, the one with the least hash of the text, so
    that no more rows than marks has are learned from. marks has a bounded number of rows."""
    both = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    others = [c for c in marks.columns if c != "doc_id"]
    return both.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), *(F.min(c).alias(c) for c in others))


def fails_base(counts: list[int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> gbt.Trees:
    """Trees for P(quality = 1), from at most `sample` labelled documents; the driver gets their statistics only."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).where("q <> 0.5")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.expr("q > 0.5").alias("__good"))
    taken = labelled(docs, marks)

    def make():
        def run(columns: list[list]) -> list[list]:
            return [columns[0], columns[1], [statistics(t)[1] for t in columns[2]]]

        return run

    rows = map_rows(taken, ["doc_id", "__good", "text"], make, fields("doc_id bigint, good boolean, x array<double>")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return gbt.fit(x, np.array([r["good"] for r in rows], float), list(FEATURES.values()))


def _verdicts(trees: gbt.Trees, texts: list[str | None], cut: float) -> tuple[list[list[int]], list[bool], list[float]]:
    made = [statistics(t) for t in texts]
    p = trees.probability(np.array([x for _, x in made], float).reshape(len(made), len(FEATURES)))
    return [c for c, _ in made], [fails_base(c) for c, _ in made], p.tolist()


def score(docs: DataFrame, trees: gbt.Trees, cut: float = CUT) -> DataFrame:
    """(doc_id, the counts, base_failed, kept, p_quality) of each row."""

    def make():
        def run(columns: list[list]) -> list[list]:
            counts, failed, p = _verdicts(trees, columns[1], cut)
            return [columns[0], *([c[k] for c in counts] for k in range(len(COUNTS))), failed, [not f and x >= cut for f, x in zip(failed, p, strict=True)], p]

        return run

    return map_rows(docs, ["doc_id", "text"], make, fields("doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, kept boolean, p_quality double"))


def keep_good(docs: DataFrame, trees: gbt.Trees, cut: float = CUT) -> DataFrame:
    """The rows that pass, with all their columns, whatever their ids; null and empty texts do not."""

    def make():
        def run(columns: list[list]) -> list[bool]:
            _, failed, p = _verdicts(trees, columns[0], cut)
            return [not f and x >= cut for f, x in zip(failed, p, strict=True)]

        return run

    return filter_rows(docs, ["text"], make)
