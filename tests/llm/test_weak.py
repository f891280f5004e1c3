import re
from collections import Counter

import duckdb
import pytest

from reelspark.llm import catalog, weak

PROSE = "Then the old man went home and slept well. "
TEXTS = [None, "", " \n\t", "one", "a b c d e " * 3, "a b c d e f g h i j", "x\n x\nx\n\n", "# $ % & | < > *", PROSE * 2, "LOUD!! WORDS!! " * 20, "word " * 60, "a b c d e a b c d e", "   é ü"]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def row(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, words string")
    got = {r["doc_id"]: row(r) for r in weak.statistics(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_estimation_finds_the_rules_worth():
    """Votes drawn from known rates on two classes: the classes come back."""
    k = len(weak.RULES)
    good, bad = (1,) + (None,) * (k - 1), (0, 0, 0) + (None,) * (k - 3)
    model = weak.estimate([(good, 900), (bad, 90), ((None,) * k, 10)])
    assert 0.85 < model["prior"] < 0.95
    assert weak.posterior(good, model["prior"], model["rate"]) > 0.99 and weak.posterior(bad, model["prior"], model["rate"]) < 0.01
    assert weak.estimate([])["prior"] == 0.8


def test_judgement(spark):
    prose = [" ".join(f"{a}{b} went to see {b}{a} and then" for a in "bcdfg" for b in x) + "." for x in ("aeiou", "eioua", "lmnop", "qrstu", "vwxyz")]
    texts = prose * 8 + ["WILD!! SHOUTS!! OF!! ALL!! KINDS!! " + " ".join(c + "X!!" for c in "ABCDEFGHIJ")] * 3 + [None, "too short", "word " * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in weak.judge(weak.statistics(docs)).collect()}
    assert [got[i] for i in range(40)] == [(False, True)] * 40
    assert [got[i][1] for i in range(40, 46)] == [False] * 6
    assert [got[i][0] for i in (43, 44, 45)] == [True] * 3


def test_distinct_words_of_the_whole_text(spark):
    varied = " ".join(f"{a}{b}" for a in "bcdfghklmn" for b in "aeiouxyzwv")
    texts = [varied, varied + " word" * 3000, "word " * 100 + " ".join([varied] * 30), "", "a b a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_distinct"], r["vote_distinct"]) for r in weak.votes(weak.statistics(docs)).collect()}
    assert got == {0: (100, 1), 1: (130, 0), 2: (3001, 1), 3: (0, None), 4: (2, 1)}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert weak.judge(weak.statistics(docs)).collect() == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    got = {r["doc_id"]: r for r in catalog.op8_weak_supervision(spark, sf).collect()}
    for k, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        want = brute(t)
        assert row(got[k]) == want
        assert got[k]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (got[k]["base_failed"] and got[k]["kept"])
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    for kind in (0, 1):
        own = [got[k]["kept"] == bool(q) for k, q in label.items() if q == kind and got[k]["n_words"] >= 10]
        assert sum(own) >= 0.95 * len(own)
