import random
import re

from reelspark.llm import decontam

ITEM = "a train leaves the station with 40 km left and 3 hours later it passes the old bridge"


def rows(df):
    return {(r["doc_id"], r["item_id"]): r["n_windows"] for r in df.collect()}


def test_templates_and_slots(spark):
    docs = spark.createDataFrame([
        (1, f"Intro words here. {ITEM} and more"),
        (2, ITEM.replace("40", "75").replace("3 hours", "9 days")),  # other figures and units
        (3, ITEM.replace("the station", "the harbour").replace("later", "earlier")),  # no run is long enough
        (4, None), (5, ""), (6, "short"), (None, ITEM), (1, "quite another text under the same id that shares nothing at all here"),
        (7, ITEM.upper() + "!!"),
    ], "doc_id long, text string")
    items = spark.createDataFrame([(10, ITEM, 0), (11, None, 0), (12, "", 0), (13, "too short", 0)], "item_id long, text string, n long")
    assert set(rows(decontam.leaks(docs, items))) == {(1, 10), (2, 10), (None, 10)}
    kept = decontam.clean(docs.selectExpr("*", "1 as bad_id", "2 as row", "3 as item_id"), items)
    assert kept.columns == ["doc_id", "text", "bad_id", "row", "item_id"]
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in kept.collect()) == [(1, "quite"), (3, "a tra"), (4, ""), (5, ""), (6, "short"), (7, "A TRA")]  # by templates alone
    assert 7 not in {r["doc_id"] for r in decontam.clean(docs, items, exact=True).collect()}


def test_slots_must_answer_each_other(spark):
    item = "add 5 apples to 7 pears then take 5 apples away and count the fruit"
    docs = spark.createDataFrame([(1, item.replace("5", "8")), (2, "add 8 apples to 7 pears then take 9 apples away and count the fruit"),
                                  (3, item.replace("7", "5"))], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = rows(decontam.leaks(docs, items))
    assert (1, 1) in got
    # windows that hold only one of the two fives agree in any case; those that hold both don't
    assert got.get((2, 1), 0) < got[(1, 1)] and got.get((3, 1), 0) < got[(1, 1)]


def test_names_are_slots(spark):
    item = "yesterday we saw that Anna Bell gave ten red books to the school and left"
    docs = spark.createDataFrame([(1, item.replace("Anna Bell", "Carl Dunn"))], "doc_id long, text string")
    assert rows(decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))) != {}


def test_short_items_and_every_place(spark):
    item = "one two three four five six"
    texts = [" ".join([f"w{i}" for i in range(k)] + [item]) for k in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert set(rows(decontam.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")))) == {(k, 1) for k in range(8)}
    long = " ".join(f"v{chr(97 + i)}" for i in range(decontam.RUN))
    docs = spark.createDataFrame([(k, " ".join([f"q{chr(97 + i)}" for i in range(k)] + [long])) for k in range(8)], "doc_id long, text string")
    assert set(rows(decontam.leaks(docs, spark.createDataFrame([(1, long)], "item_id long, text string")))) == {(k, 1) for k in range(8)}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(docs, items).collect() == [] and decontam.clean(docs, items).collect() == []
    some = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert decontam.clean(some, items).count() == 1


def test_exact_copies_in_any_context_case_and_wrapping(spark):
    items = spark.createDataFrame([(1, "Paris lies on the Seine"), (2, "Anna Bell Carl Dunn Emma Ford Gina Hall Ivan Jones Kate Lund Mia"), (3, "1 + 2 = 3, 4 + 5 = 9, 6 + 7 = 13, 8 + 9 = 17"),
                                   (4, "two words"), (5, ITEM), (6, None), (7, "..")], "item_id long, text string")
    texts = {1: "we know, Paris lies on the Seine today", 2: "so (Anna Bell Carl Dunn Emma Ford Gina Hall Ivan Jones Kate Lund Mia)", 3: "sums: 1 + 2 = 3, 4 + 5 = 9, 6 + 7 = 13, 8 + 9 = 17 and so on",
             4: "here Two\n Words stand", 5: ITEM.upper() + "!!", 6: ITEM.replace(" ", "\n  "), 7: "two other words", 8: None, 9: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert set(rows(decontam.copies(docs, items))) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5)}
    assert {r["doc_id"] for r in decontam.clean(docs, items, exact=True).collect()} == {7, 8, 9}
    assert decontam.copies(docs, items.where("false")).collect() == [] and decontam.copies(docs.where("false"), items).collect() == []
    assert {r["doc_id"] for r in decontam.clean(docs, items.union(spark.createDataFrame([(8, "other")], items.schema)), exact=True).collect()} == {7, 8, 9}
    assert 7 not in {r["doc_id"] for r in decontam.clean(docs, items.union(spark.createDataFrame([(8, "other")], items.schema)), exact=True, least_words=1).collect()}


def plain(docs, items):
    """(doc_id, item_id, kind): windows agreeing pair by pair, read from the texts word by word."""
    number, unit = re.compile(decontam.NUMBER), re.compile(f"(?:{decontam.UNITS})", re.I)

    def typed(text):
        out, after = [], False
        for raw in text.split():
            value = "".join(c for c in raw.lower() if c.isalnum())
            if not value:
                continue
            bare = raw.strip(".,:;!?()'")
            kind = "num" if number.fullmatch(bare) else "unit" if after and unit.fullmatch(bare) else "name" if bare[:1].isupper() and bare.replace("-", "").isalpha() else value
            out.append((kind, value))
            after = kind == "num" and raw[-1:].isdigit()
        return out

    found = set()
    for d, text in docs:
        for i, item in items:
            for kind, of, least in (("template", typed, decontam.LEAST), ("words", lambda t: [(w, w) for w in re.findall(r"[^\W_]+", t.lower())], 1)):
                a, b = of(item), of(text)
                n = min(decontam.RUN, len(a))
                for x in range(len(a) - n + 1 if n >= least else 0):
                    for y in range(len(b) - n + 1):
                        one, two = a[x : x + n], b[y : y + n]
                        slots = [(p[1], q[1]) for p, q in zip(one, two, strict=True) if kind == "template" and p[0] in ("num", "unit", "name")]
                        pairs = set(slots)
                        if [p[0] for p in one] == [q[0] for q in two] and (all(p == q for p, q in pairs) or 2 * len(slots) <= n and len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})):
                            found.add((d, i, kind))
    return found


def test_against_plain_windows(spark):
    rng = random.Random(8)
    words = ["Anna", "Bell", "Oslo", "lake", "boat", "red", "and", "of", "12", "7", "3.5", "km", "hours", "the", "goes", "Seine"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 6, 9, 14, 20])))) for i in range(14)]

    def changed(text):
        kind = rng.randrange(5)
        if kind == 0:
            return text.upper()
        if kind == 1:
            return text.replace(" ", "\n ")
        swap = dict(zip(["Anna", "12", "7"], ["Emma", "40", "9"] if kind == 2 else ["Emma", "40", "40"], strict=True))
        return text if kind == 3 else " ".join(swap.get(w, w) for w in text.split())

    docs = [(d, " ".join(rng.choices(words, k=rng.randrange(6))) + rng.choice([" ", ", ", " ("]) + changed(rng.choice(items)[1]) + rng.choice(["", ")", ". "]) + " " + " ".join(rng.choices(words, k=rng.randrange(6)))) for d in range(60)]
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["kind"]) for r in got.collect()} == plain(docs, items)
