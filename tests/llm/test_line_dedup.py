"""Line dedup against searches of its own, not by the operator's units."""

import re
from collections import Counter

import duckdb
from conftest import DATA

from shalegrid.llm import line_dedup


def stays(spark, rows):
    return [r["text"] for r in line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]


def test_short_copies_go(spark):
    rows = [(1, "First own text stands here.\nAll rights are reserved.\nMenu\nOwn one."), (2, "Second own text.\nAll rights are reserved.\nMenu\nOwn two. Yes."), (3, "Third text of its own! First own text stands here. Yes. End of three.")]
    assert sorted(stays(spark, rows)) == sorted([rows[0][1], "Second own text.\nOwn two. Yes.", "Third text of its own! Yes. End of three."])


def test_no_whole_line_stays_twice(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/sf0.01/documents.parquet'").fetchall()
    norm = lambda line: " ".join(re.findall(r"\w+", line.lower()))
    before = Counter(n for _, t in docs for x in t.split("\n") if len((n := norm(x)).split()) >= 3 and not re.search(r"[.!?][ \t]+\S", x))
    after = Counter(norm(x) for t in stays(spark, docs) for x in t.split("\n"))
    repeated = [n for n, c in before.items() if c > 1]
    assert repeated and all(after[n] <= 1 for n in repeated)


def windows(text, n=50):
    w = re.findall(r"\w+", text.lower())
    # Stretches in which a few words are said over and over are not passages.
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1) if len(set(w[i : i + n])) > n // 2}


def test_no_passage_of_fifty_words_stays(spark):
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/sf0.01/documents.parquet'").fetchall()
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    seen: set = set()
    for d, t in sorted(docs):
        assert seen.isdisjoint(windows(got[d])), d
        seen |= windows(t)


def test_passage_without_ends_goes(spark):
    said = " ".join(f"word{i}" for i in range(60))
    broken = said.replace("word30 ", "word30\n")
    rows = [(1, f"one begins {said} and goes on"), (2, f"two begins here {broken} and ends")]
    one, two = sorted(stays(spark, rows))
    assert one == rows[0][1] and not windows(one, 39) & windows(two, 39) and two.startswith("two begins here") and two.endswith("and ends")


def test_repeated_and_null_ids_keep_their_own_text(spark):
    said = [f"Text {x} has its own first line.\nThen {x} says quite another thing.\nAt last {x} ends here." for x in "abcde"]
    rows = [(1, said[0]), (None, said[0]), (None, said[1]), (None, said[2]), (None, said[2]), (2, said[3]), (2, said[4]), (2, said[4])]
    got = line_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", said[0]), ("None", ""), ("None", said[1]), ("None", said[2]), ("None", ""), ("2", said[3]), ("2", said[4]), ("2", "")])


def segments(text):
    """(start, end, whole line?) of each line or, where it holds several, sentence."""
    at = 0
    for line in text.split("\n"):
        parts = [*re.finditer(r"\S.*?(?:[.!?]+(?=[ \t])|$)", line)]
        for m in parts:
            yield at + m.start(), at + m.end(), len(parts) == 1
        at += len(line) + 1


def test_against_plain_search(spark):
    """What goes has an earlier copy, word for word, and every line or sentence with one goes."""
    docs = duckdb.sql(f"select doc_id, text from '{DATA}/sf0.01/documents.parquet' order by 1").fetchall()
    got = {r["doc_id"]: r for r in line_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    units, grams, n = set(), set(), 0
    for d, text in docs:
        words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", text)]
        gone = [any(x["start"] <= a and b <= x["end"] for x in got[d]["removed"]) for a, b, _ in words] if len(got[d]["removed"]) else [False] * len(words)
        covered, must, own = [False] * len(words), [False] * len(words), []
        for start, end, line in segments(text):
            inside = [i for i, (a, b, _) in enumerate(words) if start <= a and b <= end] if len(words) < 3000 else []
            unit = " ".join(words[i][2] for i in inside)
            if len(inside) >= (1 if line else 3):
                if unit in units:
                    for i in inside:
                        covered[i] = must[i] = True
                units.add(unit)
        for i in range(len(words) - 19):
            gram = " ".join(w for *_, w in words[i : i + 20])
            if gram in grams:
                covered[i : i + 20] = [True] * 20
            own.append(gram)
            if len(own) >= 20:
                grams.add(own[-20])
        grams.update(own)
        if len(words) >= 3000:
            continue
        assert all(g for g, m in zip(gone, must) if m), d
        runs = re.finditer("0+", "".join("01"[c] for c in covered))
        for m in runs:  # at most two words between removed spans go without a copy of their own
            assert m.end() - m.start() < 3 or not all(gone[m.start() : m.end()]), (d, m)
            assert sum(gone[m.start() : m.end()]) <= 2 * 2, (d, m)
        n += sum(gone)
    assert n > 10_000


def test_frequent_digests_change_nothing(spark, monkeypatch):
    docs = [(i, f"A line that all of them have in common.\nOwn words of number {i} stand here alone.\nShort one\nA line that all of them have in common.") for i in range(200)]
    one = sorted(stays(spark, docs))
    monkeypatch.setattr(line_dedup, "OFTEN", 10**9)
    assert one == sorted(stays(spark, docs)) and sum("in common" in t for t in one) == 1
