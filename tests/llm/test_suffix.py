import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from reelspark.llm import suffix


def brute(rows, length):
    """Per row: bytes, removed, spans, kept."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        mark = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(x, mark, strict=True) if not m)
        out.append((len(x), len(x) - len(kept), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark)), kept))
    return out


def run(spark, rows, length):
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, kept long")
    got = suffix.without_repeats(docs, length).collect()
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got), key=str)


def want(rows, length):
    return sorted(((k, *x) for (k, _), x in zip(rows, brute(rows, length), strict=True)), key=str)


@pytest.mark.parametrize("sigma", [5, 600])
def test_suffix_arrays(sigma):
    r = np.random.default_rng(3)
    for _ in range(150):
        s = np.append(r.integers(1, int(r.integers(2, 5)), int(r.integers(0, 60))), 0)
        assert suffix.suffix_array(s, sigma).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())  # noqa: B023


def test_repeats_of_regions():
    r = np.random.default_rng(4)
    for t in range(150):
        n = int(r.integers(2, 9))
        regions = [bytes(r.integers(97, 99 + t % 3 * 8, int(r.integers(n, 40))).astype(np.uint8)) for _ in range(int(r.integers(1, 8)))]
        seen = Counter(x[i : i + n] for x in regions for i in range(len(x) - n + 1))
        for x, mark in zip(regions, suffix.repeats(regions, n), strict=True):
            assert mark.tolist() == [seen[x[i : i + n]] > 1 for i in range(len(x) - n + 1)]


def sample(r):
    passage = "".join(map(chr, r.integers(97, 123, 70)))
    rows = []
    for k in range(40):
        a, b = ("".join(map(chr, r.integers(97, 123, int(r.integers(0, 50))))) for _ in range(2))
        rows.append((k, a + passage[: int(r.integers(20, 71))] + b if k % 3 else a + b))
    return [*rows, (40, None), (41, ""), (42, "z" * 100), (43, "ab" * 60), (44, "ab" * 60), (45, "é" * 30 + passage), (45, "x"), (None, passage), (46, "ab" * 11)]


def test_windows_beside_a_string():
    r = np.random.default_rng(5)
    for t in range(200):
        n, k = int(r.integers(4, 12)), int(r.integers(1, 4))
        regions, at = [], []
        for _ in range(int(r.integers(1, 9))):
            a, b = int(r.integers(0, n - k + 1)), int(r.integers(0, n - k + 1))
            if a + b + k >= n:
                part = lambda m: bytes(r.integers(97, 99 + t % 2 * 9, m).astype(np.uint8))  # noqa: B023, E731
                regions.append(part(a) + b"#" * k + part(b))
                at.append(a)
        seen = Counter(x[i : i + n] for x in regions for i in range(len(x) - n + 1))
        for x, mark in zip(regions, suffix.beside(regions, np.array(at), n, k), strict=True):
            assert mark.tolist() == [seen[x[i : i + n]] > 1 for i in range(len(x) - n + 1)]


def test_windows_beside_a_string_that_stands_again():
    r = np.random.default_rng(6)
    for t in range(400):
        n, k = int(r.integers(5, 14)), int(r.integers(1, 4))
        own, regions = b"ab#"[:k] if t % 2 else b"#" * k, []
        for _ in range(int(r.integers(1, 7))):
            part = lambda m: bytes(r.integers(97, 99, m).astype(np.uint8))  # noqa: B023, E731
            x = b"".join(part(int(r.integers(0, n - k + 1))) + own for _ in range(int(r.integers(1, 9)))) + part(int(r.integers(0, n - k + 1)))
            if len(x) >= n and all(own in x[i : i + n] for i in range(len(x) - n + 1)):
                regions.append(x)
        seen = Counter(x[i : i + n] for x in regions for i in range(len(x) - n + 1))
        for x, mark in zip(regions, suffix.beside(regions, np.array([x.find(own) for x in regions]), n, k), strict=True):
            assert mark.tolist() == [seen[x[i : i + n]] > 1 for i in range(len(x) - n + 1)]


def test_repeated_lines_are_not_cut_to_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix, "GROUP", 60)
    levels, whole = [], suffix.repeated_windows
    monkeypatch.setattr(suffix, "repeated_windows", lambda *a: levels.append(a[3:]) or whole(*a))
    r = np.random.default_rng(8)
    rows = [(i, "".join(map(chr, r.integers(97, 123, i % 7))) + "a common line\n" * (3 + i % 5) + "z" * i) for i in range(12)]
    assert run(spark, rows, 20) == want(rows, 20)
    assert levels == [()]


@pytest.mark.parametrize(("group", "hot"), [(1 << 20, 1 << 20), (60, 1 << 20), (60, 60)])
def test_equal_brute_force(spark, monkeypatch, group, hot):
    monkeypatch.setattr(suffix, "GROUP", group)  # the second counts place by place, the third cuts groups again, down to whole windows
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SHARD", 400)
    rows = sample(np.random.default_rng(group))
    assert run(spark, rows, 20) == want(rows, 20)


def test_segments(monkeypatch):
    data = np.frombuffer(b"abcabcabcabcxyz" * 20, np.uint8)
    whole = suffix.Filer(20, 4)(data)
    monkeypatch.setattr(suffix, "SEGMENT", 16)
    parts = suffix.Filer(20, 4)(data)
    assert np.repeat(whole[0], whole[2] - whole[1]).tolist() == np.repeat(parts[0], parts[2] - parts[1]).tolist()


def test_empty_and_short(spark):
    assert suffix.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "short"), (2, "short")]
    assert run(spark, rows, 400) == want(rows, 400)


def test_query(spark):
    from reelspark.llm import catalog

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in catalog.op5_suffix_arrays(spark, sf).collect()}
    assert got == {k: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for (k, _), x in zip(rows, brute(rows, 400), strict=True)}


def test_planted_passages(spark):
    r = np.random.default_rng(9)
    prose = lambda n: " ".join("".join(map(chr, r.integers(97, 123, int(r.integers(2, 11))))) for _ in range(n))
    passages = [prose(int(n)) for n in r.integers(51, 90, 16)]  # over 50 words, some under 400 bytes
    assert {len(p) >= suffix.LENGTH for p in passages} == {True, False}
    rows = [(k, f"{prose(60)} {passages[k // 2] if k < 32 else ''} {prose(60)}") for k in range(48)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k in range(48):
        shared = len(passages[k // 2]) + 2 if k < 32 else 0  # with the blanks around it
        assert got[k][0] >= shared if shared >= suffix.LENGTH else got[k] == (0, 0)


def test_shared_words_below_the_byte_length(spark):
    r = np.random.default_rng(10)
    word = lambda: "".join(map(chr, r.integers(97, 123, int(r.integers(1, 6)))))
    prose = lambda n: [word() for _ in range(n)]
    texts = []
    for n in (50, 51, 52, 60):  # strings of n words, each in two documents; all under 400 bytes
        p = prose(n)
        assert len(" ".join(p)) < suffix.LENGTH
        texts += [" ".join(prose(30) + p + prose(9)), "\n".join(p), " ".join(prose(20) + p)]
    own = prose(51)
    texts += [" ".join(own + prose(3) + own), " ".join(prose(50)), " ".join(prose(90)), "", None, " \n", "é " * 50]
    texts += [" ".join(prose(51))] * 2 + [" ".join(prose(50))] * 2 + ["".join(map(chr, r.integers(97, 123, 3000))) + " " + " ".join(prose(60))]

    def strings(t):
        w = (t or "").split()
        return {tuple(w[i : i + 51]) for i in range(len(w) - 50)}

    where = Counter(x for t in texts for x in strings(t))
    want = {k: sum(where[x] > 1 for x in strings(t)) for k, t in enumerate(texts)}
    assert [want[k] for k in range(15)] == [0] * 3 + [1] * 3 + [2] * 3 + [10] * 3 + [0] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix.without_repeats(docs).collect()
    assert {r["doc_id"]: r["n_shared"] for r in got} == want
    assert all(r["n_removed"] == 0 for r in got)


def test_codes_of_words_in_segments(monkeypatch):
    texts = ["one two  three".encode(), b"", b"\tthree" + b"x" * 90 + b" two\n", b"one", ("é" * 70).encode()]
    whole = suffix.word_codes(texts, suffix.Filer(3, 2))
    assert whole[1].tolist() == [0, 0, 0, 2, 2, 3, 4]
    assert whole[0][0] == whole[0][5] and whole[0][1] == whole[0][4] and len(set(whole[0].tolist())) == 5
    strings = suffix.passages(texts * 9, suffix.Filer(3, 2))
    monkeypatch.setattr(suffix, "SEGMENT", 16)
    assert suffix.word_codes(texts, suffix.Filer(3, 2))[0].tolist() == whole[0].tolist()
    assert [x.tolist() for x in suffix.passages(texts * 9, suffix.Filer(3, 2))] == [x.tolist() for x in strings]
