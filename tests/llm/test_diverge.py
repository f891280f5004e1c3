import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reelspark.llm import diverge

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=3, shown=200):
    docs = [tuple("" if x is None else x for x in d) for d in docs]
    out = []
    for lang in {d[1] for d in docs}:
        words = [(s, WORD.findall(t.translate(LOWER))) for t, g, s in docs if g == lang]
        seen = Counter(w for _, ws in words for w in set(ws))
        kept = sorted(w for w, n in seen.items() if n >= least)
        count = {s: Counter() for s, _ in words}
        for s, ws in words:
            count[s].update(w for w in ws if seen[w] >= least)
        whole = sum(count.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}
        each, q = {s: p(c) for s, c in count.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s, own in each.items():
            pairs = [(-sum(f(own[w], o[w]) for w in kept), t) for t, o in each.items() if t != s]
            terms = [(-f(own[w], q[w]), w) for w in kept if count[s][w] and own[w] > q[w]]
            for part, items, most in (("pair", pairs, 10**9), ("term", terms, shown)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, r) for r, (v, item) in enumerate(items[:most], 1)]
    return sorted(out)


def made(rng, n, sources):
    words = ["Über", "uber", "the", "THE", "ça", "x", "漢字", "don't", "a1b", "𐐀", "é", "z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    docs = [(" ".join(rng.choices(words, k=rng.randrange(60))), rng.choice(["en", "de", ""]), f"s{rng.randrange(sources)}") for _ in range(n)]
    return docs + [(None, None, None), ("", "zz", "a"), (None, "zz", "b"), ("rare rare rare", "yy", "é"), ("rare", "yy", "z"), *[("one", "xx", "a")] * 3, ("one", "xx", None)]


def test_against_all_terms(spark, monkeypatch):
    monkeypatch.setattr(diverge, "SEGMENT", 16)
    monkeypatch.setattr(diverge, "BLOCK", 4)
    docs = made(random.Random(1), 150, 11)
    df = spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("x"), "value": F.lit(2)})
    got = sorted(tuple(r) for r in diverge.audit(df).collect())
    assert got == brute(docs)
    assert sorted(tuple(r) for r in diverge.audit(df, 1, 5).collect()) == brute(docs, 1, 5)


def test_long_text_and_empty(spark):
    long = "α" * 300_000
    docs = [(f"{long} a b", "en", "s"), (f"{long} a", "en", "t"), (long, "en", "t")]
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert sorted(tuple(r) for r in diverge.audit(df).collect()) == brute(docs)
    assert diverge.audit(df.where("false")).collect() == []


def test_parts_are_handed_on(spark, monkeypatch):
    docs = made(random.Random(2), 80, 3)
    df = spark.createDataFrame(docs, "text string, lang string, source string").coalesce(1)
    whole = diverge.counted(df).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("df"))
    monkeypatch.setattr(diverge, "HELD_TEXT", 100)
    assert sorted(map(tuple, diverge.counted(df).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("df")).collect())) == sorted(map(tuple, whole.collect()))


def test_trees_price_every_term():
    rng = np.random.default_rng(4)
    for terms in (1, 2, 3, 17, 64, 200):
        counts = rng.poisson(0.7, (6, terms))
        counts[3] = counts[2]
        total = counts.sum(1) + terms
        a, b = np.triu_indices(6, 1)
        there, back = diverge.priced(counts, total, a, b)
        p = 1 + 10**9 * (counts + 1) // total[:, None]
        assert there.tolist() == ((p[a] - p[b]) ** 2 // p[b]).sum(1).tolist()
        assert back.tolist() == ((p[a] - p[b]) ** 2 // p[a]).sum(1).tolist()
        trees = diverge.Trees(counts)
        assert trees.roots[2] == trees.roots[3]
    same = diverge.Trees(np.zeros((5, 64), np.int64))
    assert all(len(x) == 1 for x in same.left) and len(same.walk(same.roots[:1], same.roots[1:2])[0]) == 1


def test_shares_of_large_counts(spark):
    cases = [(0, 1), (0, 3), (10**14, 10**14 + 7), (12345678901234, 98765432109876)]
    df = spark.createDataFrame(cases, "n long, t long")
    assert [r[0] for r in df.select(diverge.share(F.col("n"), F.col("t"))).collect()] == [1 + 10**9 * (n + 1) // t for n, t in cases]
