import tracemalloc

import duckdb

from reelspark.llm import catalog, langid

EN, DE = "the ship with their thing that was there this they", "und der nicht schlicht eine zeit ich auch durch keine"
RU = "это был человек который знал всё и ничего больше"


def trained(spark):
    rows = [(EN, "en")] * 20 + [(DE, "de")] * 20 + [(RU, "ru")] * 20 + [(None, "en"), ("left out", None), ("", "de")]
    return langid.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_spans_scripts_and_edges(spark):
    texts = [None, "", "123 !!! ...", EN, f"{EN} {DE}", RU, f"{EN} человек {EN}", f"{DE} {DE} the {DE}", EN, "x" * 3000]
    docs = spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, spans int")
    got = {r["doc_id"]: r for r in langid.label(docs, trained(spark)).collect()}
    assert [got[i]["lang_pred"] for i in range(9)] == ["und", "und", "und", "en", got[4]["lang_pred"], "ru", "en", "de", "en"]
    assert got[0]["score"] == 0.0 and got[3]["score"] == 1.0 and got[3]["spans"] == "en:0:10"
    assert got[4]["spans"] == "en:0:10,de:10:20" and got[7]["spans"] == "de:0:31"  # one foreign word is no switch
    assert "ru:10:11" in got[6]["spans"]  # but one of a foreign script is
    assert len(got) == len(texts) and 0 <= got[9]["score"] <= 1


def test_letters_and_marks(spark):
    texts = ["½", "² ① Ⅷ 3", "ª", "हिन्दी"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["lang_pred"] for r in langid.label(docs, trained(spark)).orderBy("doc_id").collect()]
    assert got[:2] == ["und", "und"] and "und" not in got[2:]
    assert langid.letters("हिन्दी") == "\x02हिन्दी\x03"


def test_many_languages(spark):
    names = [f"l{i:03}" for i in range(200)]
    words = {n: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + j)}" for j in range(26)) for i, n in enumerate(names)}
    model = langid.fit(spark.createDataFrame([(words[n], n) for n in names], "text string, lang string"))
    docs = spark.createDataFrame([(i, words[n]) for i, n in enumerate(names)], "doc_id long, text string")
    got = [r["lang_pred"] for r in langid.label(docs, model).orderBy("doc_id").collect()]
    assert sum(a == b for a, b in zip(got, names, strict=True)) > 190


def test_memory_of_texts_without_blanks(spark):
    """Memory follows a fixed part of the text, not its length."""
    label, peaks = langid.Labeller(trained(spark)), []
    for n in (1 << 20, 1 << 22):
        text = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(n))
        tracemalloc.start()
        out = label([text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert out["spans"][0].endswith(f":{n // langid.LONG}") and not any(len(c) > langid.REMEMBERED for c in label.memory)
    assert peaks[1] < 2 * peaks[0] + (1 << 22)


def test_nothing_learned_and_empty(spark):
    model = langid.fit(spark.createDataFrame([], "text string, lang string"))
    docs = spark.createDataFrame([(1, EN), (2, None)], "doc_id long, text string")
    assert [(r["lang_pred"], r["score"]) for r in langid.label(docs, model).collect()] == [("und", 0.0)] * 2
    assert langid.label(docs.where("false"), trained(spark)).collect() == []


def test_counts_cover_all_rows(spark):
    rows = [("ab", "x"), ("ab ab", "x"), ("ab", "y")]
    got = {(r["lang"], r["slot"]): r["n"] for r in langid.count(spark.createDataFrame(rows, "text string, lang string").repartition(3)).collect()}
    assert {n for (lang, _), n in got.items() if lang == "x"} == {3} and {n for (lang, _), n in got.items() if lang == "y"} == {1}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    want = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    rows = [r for r in catalog.op10_language_spans(spark, sf).collect() if r["held_out"]]
    assert len(rows) > 200 and sum(r["lang_pred"] == want[r["doc_id"]] for r in rows) >= 0.98 * len(rows)
