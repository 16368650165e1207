"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

Evidence of a document: log-odds of good quality (a logistic fit on text statistics) and of toxicity (a logistic fit on
words and word beginnings that tell the classes apart, by likelihood ratio). Both learn from SAMPLE labelled documents at
most, those with the least hash of the id. The sample's words are counted on the executors; a term is learned from if enough
documents have it and its likelihood ratio is high enough, however many such terms there are.

Evidence is then pooled over all documents: the mean of each host is shrunk toward the global mean, the mean of each path
toward its host's, by a prior strength that the method of moments takes from the spread of the groups within their parents
beyond what their sizes explain. Without such spread, or with too few groups to tell, a group has its parent's mean. A
document's posterior log-odds are its evidence plus the log-odds of its path's posterior beyond those of the global prior.
Sites with few documents add little, sites with many say what they are.

A null text is an empty one; null hosts and paths are groups of their own; equal rows are each returned and counted. Labels
that are null, or contradict each other evenly for one id, are not learned from; of rows that share a labelled id the one
with the least hash of its text is. Without labels of both classes the evidence is the smoothed share of the class. An empty
table gives no rows. Columns besides doc_id, text, the host and the path are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalegrid.llm.common import fields, map_rows, small_enough, staged, unstage
from shalegrid.llm.quality_rules import FEATURES, labelled, statistics

SAMPLE = 10_000
#: Labelled documents that must have a term, and the least likelihood ratio.
SUPPORT, RATIO = 6, 20.0
#: Least hashes of terms by which copies among labelled documents are known.
SKETCH = 16
#: Lengths of word beginnings.
HEADS = range(3, 9)
#: Probabilities: below the first one quality rejects, from the second one toxicity does.
GOOD, TOXIC = 0.3, 0.5
SALTS = 16
WORD = re.compile(r"\w+")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Ridge logistic weights, the intercept first, by Newton steps. One class, or no rows: the smoothed share only."""
    w = np.zeros(x.shape[1] + 1)
    share = (y.sum() + 1) / (len(y) + 2)
    w[0] = np.log(share / (1 - share))
    if len(y) == 0 or y.min() == y.max():
        return w
    a = np.column_stack([np.ones(len(y)), x])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def terms_of(text: str | None) -> set[str]:
    """Distinct words in lower case, and their beginnings with a star."""
    words = set(WORD.findall((text or "").lower()))
    return words | {f"{w[:k]}*" for w in words for k in HEADS if len(w) >= k}


@dataclass
class Evidence:
    """What scores a text: scaled statistics for quality, terms for toxicity."""

    mean: np.ndarray
    scale: np.ndarray
    quality: np.ndarray
    terms: dict[str, float]
    toxic: float

    def __post_init__(self):
        self.least = min((len(t.rstrip("*")) for t in self.terms), default=0)
        self.starts = {t[: self.least] for t in self.terms}

    def term_score(self, text: str) -> float:
        words = [w for w in set(WORD.findall(text.lower())) if w[: self.least] in self.starts]
        found = {t for w in words for t in (w, *(f"{w[:k]}*" for k in HEADS if len(w) >= k)) if t in self.terms}
        return sum(self.terms[t] for t in found)

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[float]]:
        if not texts:
            return [], []
        x = (np.array([statistics(t)[1] for t in texts], float) - self.mean) / self.scale
        good = self.quality[0] + x @ self.quality[1:]
        bad = self.toxic + np.array([self.term_score(t or "") for t in texts])
        return good.tolist(), bad.tolist()


def telling(counts: list[tuple[str, int, float]]) -> list[str]:
    """Of (term, toxic documents, likelihood ratio), best first: those that no shorter beginning of theirs tells as well."""
    ratio = {t: g for t, _, g in counts}
    covered = lambda t: any(ratio.get(f"{t[:k]}*", -1.0) >= ratio[t] for k in HEADS if k < len(t.rstrip("*")) or (k == len(t) and not t.endswith("*")))
    return [t for t, _, _ in counts if not covered(t)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Evidence:
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("__q"), F.avg("toxic").alias("__t"))
    taken = labelled(docs, marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    taken = taken.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")  # few rows, much work for each

    def make():
        def run(columns: list[list]) -> list[list]:
            terms = [[*terms_of(t)] for t in columns[3]]
            sketches = [sorted(xxhash.xxh64_intdigest(w) >> 1 for w in ws)[:SKETCH] for ws in terms]
            return [*columns[:3], [statistics(t)[1] for t in columns[3]], terms, sketches]

        return run

    kinds = "doc_id bigint, q double, t double, x array<double>, terms array<string>, sketch array<bigint>"
    seen = staged(map_rows(taken, ["doc_id", "__q", "__t", "text"], make, fields(kinds), size=1 << 20), "labelled")
    # Copies would count a term of theirs many times: documents that share their least term hashes count once.
    once = seen.where("t is not null and t <> 0.5").groupBy("sketch").agg(F.min_by(F.struct((F.col("t") > 0.5).alias("bad"), "terms"), "doc_id").alias("s")).select("s.*")
    n = once.agg(F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"), F.count("*").alias("all")).first()
    n1, n0 = n["bad"], n["all"] - n["bad"]
    terms: list[str] = []
    if n1 and n0:
        by_term = once.select("bad", F.explode("terms").alias("term")).groupBy("term").agg(F.sum(F.col("bad").cast("long")).alias("a"), F.count("*").alias("n"))
        by_term = by_term.where(f"n >= {SUPPORT} and a * {n1 + n0}D > n * {n1}D")
        by_term = by_term.selectExpr("term", "a", f"2 * (a * ln(a / (n * {n1 / (n1 + n0)}D)) + (n - a) * ln(greatest(n - a, 0.5D) / (n * {n0 / (n1 + n0)}D))) as g").where(F.col("g") >= RATIO)
        terms = telling([(r["term"], r["a"], r["g"]) for r in by_term.orderBy(F.desc("g"), "term").collect()])
    place = {t: i for i, t in enumerate(terms)}
    scored = seen.select("doc_id", "q", "t", "x", F.array_intersect("terms", F.array(*map(F.lit, terms)).cast("array<string>")).alias("terms")).collect()
    scored.sort(key=lambda r: r["doc_id"])
    unstage(seen)
    x = np.array([r["x"] for r in scored], float).reshape(len(scored), len(FEATURES))
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    q = np.array([np.nan if r["q"] is None or r["q"] == 0.5 else r["q"] for r in scored], float)
    t = np.array([np.nan if r["t"] is None or r["t"] == 0.5 else r["t"] for r in scored], float)
    s = np.zeros((len(scored), len(terms)))
    for i, r in enumerate(scored):
        s[i, [place[w] for w in r["terms"]]] = 1
    has_q, has_t = ~np.isnan(q), ~np.isnan(t)
    toxic = logistic(s[has_t], (t[has_t] > 0.5).astype(float), ridge=0.1)
    return Evidence(mean, scale, logistic((x[has_q] - mean) / scale, (q[has_q] > 0.5).astype(float)), dict(zip(terms, toxic[1:].tolist(), strict=True)), float(toxic[0]))


def strength(groups: DataFrame, parent: Column, share: str) -> float:
    """How many documents the parent's mean weighs, from the spread of group means within parents beyond what sizes explain.

    groups: n documents, the sum of the share and of its square. One at least; infinite if there is no such spread, or none
    can be told.
    """
    s, n = F.col(share), F.col("n")
    inside = groups.groupBy(parent.alias("parent")).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(share).alias("s"), F.sum(F.col(f"{share}2") - s * s / n).alias("w"), F.sum(s * s / n).alias("b"), F.sum(n * n).alias("nn")
    )
    r = inside.agg(F.sum("k").alias("k"), F.count("*").alias("h"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(F.expr("b - s * s / n")).alias("b"), F.sum(F.expr("n - nn / n")).alias("c")).first()
    if not r["k"] or r["k"] <= r["h"] or r["n"] <= r["k"] or r["c"] <= 0:
        return float("inf")
    within = max(r["w"], 0.0) / (r["n"] - r["k"])
    spread = (r["b"] - (r["k"] - r["h"]) * within) / r["c"]
    return max(1.0, within / spread) if spread > 1e-15 else float("inf")


def _shrunk(share: Column, parent: Column, weight: float) -> Column:
    return parent if weight == float("inf") else (share + weight * parent) / (F.col("n") + weight)


def _logit(p: Column) -> Column:
    """Log-odds; the bounds are what doubles can tell from 0 and 1."""
    p = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.log(p) - F.log(1 - p)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def classify(docs: DataFrame, evidence: Evidence, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """(doc_id, host, path, n_path, quality_evidence, toxic_evidence, path_quality, path_toxic, p_quality, p_toxic, toxic, kept).

    host and path default to the columns source and lang.
    """
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    rows = docs.select("doc_id", host.cast("string").alias("__host"), path.cast("string").alias("__path"), "text")

    def make():
        return lambda columns: [columns[0], columns[1], columns[2], *evidence(columns[3])]

    scored = staged(map_rows(rows, ["doc_id", "__host", "__path", "text"], make, fields("doc_id bigint, host string, path string, good double, bad double")), "evidence")
    shares = scored.select("host", "path", _sigmoid(F.col("good")).alias("q"), _sigmoid(F.col("bad")).alias("t"))
    sums = [F.count("*").alias("n"), *(F.sum(c).alias(c) for c in "qt"), *(F.sum(F.col(c) * F.col(c)).alias(f"{c}2") for c in "qt")]
    paths = staged(shares.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "q", "t", "q2", "t2")))
    total = hosts.agg(*(F.sum(c).alias(c) for c in ("n", "q", "t"))).first()
    prior = {c: (float(total[c] or 0) + 0.5) / ((total["n"] or 0) + 1) for c in "qt"}
    of_host, of_path = {c: strength(hosts, F.lit(1), c) for c in "qt"}, {c: strength(paths, F.col("host"), c) for c in "qt"}
    up = hosts.select(F.col("host").alias("__host"), *(_shrunk(F.col(c), F.lit(prior[c]), of_host[c]).alias(f"host_{c}") for c in "qt"))
    table = paths.join(up, F.col("host").eqNullSafe(F.col("__host"))).select(
        F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("n").alias("n_path"),
        *(_shrunk(F.col(c), F.col(f"host_{c}"), of_path[c]).alias(f"path_{c}") for c in "qt"),
    )
    table = staged(table, "posteriors")
    unstage(paths)
    same = F.col("host").eqNullSafe(F.col("__host")) & F.col("path").eqNullSafe(F.col("__path"))
    if small_enough(table):
        both = scored.join(F.broadcast(table), same)
    else:  # a host with a large part of all rows is dealt over SALTS tasks
        salted = table.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        both = scored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "good", "bad"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("__salt")))
    shift = {c: _logit(F.col(f"path_{c}")) - _logit(F.lit(prior[c])) for c in "qt"}
    p_q, p_t = _sigmoid(F.col("good") + shift["q"]), _sigmoid(F.col("bad") + shift["t"])
    return both.select(
        "doc_id", "host", "path", "n_path", F.col("good").alias("quality_evidence"), F.col("bad").alias("toxic_evidence"), F.col("path_q").alias("path_quality"), F.col("path_t").alias("path_toxic"),
        p_q.alias("p_quality"), p_t.alias("p_toxic"), (p_t >= TOXIC).alias("toxic"), ((p_q >= GOOD) & (p_t < TOXIC)).alias("kept"),
    )
