"""One row of each near-duplicate group stays, whatever the ids."""

import random

import pytest

from shalegrid.llm import common, simhash_dedup


def test_repeated_and_null_ids_stay_by_component(spark):
    said = [" ".join(f"{x}{i * k}" for i in range(40)) for k, x in enumerate(["ab", "cd", "ef", "gh", "ij"], 1)]
    rows = [(1, said[0]), (None, said[0]), (None, said[1]), (None, said[2]), (None, said[2]), (2, said[3]), (2, said[4]), (2, said[4]), (2, said[0])]
    got = simhash_dedup.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", said[0]), ("None", said[1]), ("None", said[2]), ("2", said[3]), ("2", said[4])])


def _said(rnd, words):
    return " ".join(f"{rnd.getrandbits(40):x}" for _ in range(words))


def test_texts_are_not_shuffled(spark, monkeypatch):
    """However many rows there are: a sieve that is sent to all tasks tells which stay."""
    rnd = random.Random(3)
    texts = [_said(rnd, 3000) for _ in range(300)]
    docs = spark.createDataFrame([(i, texts[i % 300]) for i in range(330)], "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 20)
    docs = common.staged(docs, "docs")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        done = store.executorList(False)
        return sum(done.apply(i).totalShuffleWrite() for i in range(done.size()))

    before = written()
    got = simhash_dedup.keep_first(docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == list(enumerate(texts))
    assert written() - before < 0.2 * sum(map(len, texts))


@pytest.mark.parametrize("words", [64, 1])
def test_sieves_of_any_size_lose_and_add_nothing(spark, monkeypatch, words):
    """With one word for all keys every row is held back and looked up."""
    rnd = random.Random(4)
    texts = [_said(rnd, 40) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[i]) for i in range(60)] + [(None, texts[i]) for i in range(20)]
    rows += [(None, x := _said(rnd, 40)), (None, x), (7, y := _said(rnd, 40)), (7, y), (8, None), (8, ""), (9, " ")]
    monkeypatch.setattr(common, "SIEVE_WORDS", words)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, block string")
    got = sorted(map(str, map(tuple, simhash_dedup.keep_first(docs).collect())))
    want = [(i, t or "", "x") for i, t in [*enumerate(texts), (None, x), (7, y), (8, "")]]
    assert sorted(g.replace("(8, None,", "(8, '',") for g in got) == sorted(map(str, want))
