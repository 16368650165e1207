"""Tables sent to every task, and so held by the driver, are bounded by a count, not by Spark's guess of their size."""

import random

from shalegrid.llm import common, simhash_dedup


def most_sent(spark, run):
    """Rows of the largest table that was broadcast while run() ran, and its result."""
    store = spark._jsparkSession.sharedState().statusStore()
    wait = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    wait()
    before, most = store.executionsCount(), 0
    result = run()
    wait()
    done = store.executionsList()
    for i in range(before, done.size()):
        execution = done.apply(i).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most, result


def copies(groups, each):
    rnd = random.Random(7)
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(groups)]
    return [(g * each + k, texts[g] + " end" * k) for g in range(groups) for k in range(each)]


def test_cells_are_not_sent_by_a_guess(spark):
    """Each pair shares 31 cells or so: their sizes have far more rows than the fingerprints that the plan's guess goes by."""
    rnd = random.Random(5)
    firsts = [(rnd.getrandbits(62) & ~3) | 1 for _ in range(5000)]  # 1 and 2 in the last segment: equal popcounts
    pairs = {(x, x ^ 3) for x in firsts}
    classes = spark.createDataFrame([(x, x) for p in pairs for x in p], "node bigint, fp bigint")
    most, links = most_sent(spark, lambda: simhash_dedup.links(common.staged(classes, "classes")).collect())
    assert {frozenset((r["u"], r["v"])) for r in links} >= {frozenset(p) for p in pairs}
    assert most <= common.BROADCAST_ROWS


def test_keep_first_sends_bounded_tables(spark, monkeypatch):
    docs = spark.createDataFrame(copies(30, 3), "doc_id bigint, text string")
    want = {r["doc_id"] for r in simhash_dedup.keep_first(docs).collect()}
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    most, got = most_sent(spark, lambda: {r["doc_id"] for r in simhash_dedup.keep_first(docs).collect()})
    assert got == want and {3 * g for g in range(30)} <= got and most <= 20


def test_near_duplicates_sends_bounded_tables(spark, monkeypatch):
    docs = spark.createDataFrame(copies(60, 2), "doc_id bigint, text string")
    rows = lambda: sorted(map(tuple, simhash_dedup.near_duplicates(docs).collect()))
    want = rows()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(simhash_dedup, "HOT", 20)
    most, got = most_sent(spark, rows)
    assert got == want and most <= 20
