"""Benchmark decontamination by templates.

Numbers, units and names (words with a capital, wherever they stand) become typed placeholders, so that a question
that was given other figures or names has the template of its original. Template windows of documents meet those of
the benchmark in a hash join; what they hit is compared token by token, and the values in the slots must answer each
other one to one. A document leaks an item if RUN tokens in a row agree so (all tokens of a shorter item); where values
differ, at least half of the window has to be literal.

Beside the templates, the words as they stand are compared in the same way, in any case, punctuation and white space:
RUN words of an item in a row, or all words of a shorter item. That finds what a template does not, such as copies in
capitals, and items of fewer than LEAST tokens, which say too little without their words.

The documents' windows are SEED tokens long and start at every STRIDE-th token: any RUN tokens hold one of them
whole, so nothing that agrees over RUN tokens is missed. For items shorter than RUN the documents also get windows
of the item's own length at every token.

Null texts count as empty and have no windows, on either side. Rows that are repeated are found once for each
(doc_id, text); a null doc_id is kept as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reelspark.llm.common import boxed, prepared, unboxed, written

SEED, STRIDE = 7, 6
RUN = SEED + STRIDE - 1
LEAST = 5
TEMPLATE, WORDS = "template", "words"
# Placeholders, white space, units.
NUM, NAME, UNIT = "\ue000", "\ue001", "\ue002"
MARKS = NUM + NAME + UNIT
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
UNITS = "km|kg|mg|cm|mm|ml|g|m|l|s|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|feet|inches|pounds?|euros?|dollars?|cents?|percent"
NUMBER = "[0-9]+(?:[.,:/-][0-9]+)*"


def template(text: Column) -> Column:
    """The text with placeholders, in lower case, without punctuation; white space stays where it is."""
    text = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "(^|[^\\p{L}\\p{N}])\\p{Lu}[\\p{L}-]*", f"$1{NAME}")
    text = F.regexp_replace(text, NUMBER, NUM)
    text = F.regexp_replace(text, f"(?i){NUM}([ \\t\\n\\x0B\\f\\r]*)(?:{UNITS})\\b", f"{NUM}$1{UNIT}")
    return F.regexp_replace(F.lower(text), f"[^\\p{{L}}\\p{{N}}\\s{MARKS}]", "")


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(template(text), SPACES), "")


def values(text: Column) -> Column:
    """The words behind `tokens`, one each, in lower case and without punctuation."""
    plain = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^\\p{L}\\p{N}\\s]", "")
    pairs = F.arrays_zip(F.split(template(text), SPACES).alias("t"), F.split(plain, SPACES).alias("v"))
    return F.transform(F.filter(pairs, lambda p: p["t"] != ""), lambda p: p["v"])


def plain_words(text: Column) -> Column:
    """Runs of letters and digits in lower case: the same for any case, punctuation and white space."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+"), "")


WINDOWS = "array<struct<at:int,hash:bigint>>"


def seeds(kind: str, toks: Column, length: Column | int, stride: int) -> Column:
    """(place, hash) of the windows of `length` tokens at every `stride`-th token."""
    length = F.lit(length) if isinstance(length, int) else length
    last = F.size(toks) - length
    made = F.transform(F.sequence(F.lit(0), last, F.lit(stride)), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(kind), F.slice(toks, i + 1, length)).alias("hash")))
    return F.when(last >= 0, made).otherwise(F.array().cast(WINDOWS))


def slots_answer(a: Column, x: Column, y: Column) -> Column:
    """Do the values x and y in the slots of a window a answer each other one to one? Where they differ, half the window has to be literal."""
    pairs = F.filter(F.arrays_zip(a.alias("t"), x.alias("x"), y.alias("y")), lambda p: p["t"].rlike(f"[{MARKS}]"))
    own, other = F.transform(pairs, lambda p: p["x"]), F.transform(pairs, lambda p: p["y"])
    both = F.size(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["x"], p["y"]))))
    return (own == other) | (2 * F.size(pairs) <= F.size(a)) & (both == F.size(F.array_distinct(own))) & (both == F.size(F.array_distinct(other)))


def places(dt: Column, it: Column, shift: Column, n: Column, also: Callable[[Column], Column] | None = None) -> Column:
    """Places of the item where n tokens agree with the document's, `shift` further on."""
    first, last = F.greatest(F.lit(0), -shift), F.least(F.size(it), F.size(dt) - shift) - n

    def fits(j: Column) -> Column:
        same = F.slice(it, j + 1, n) == F.slice(dt, j + shift + 1, n)
        return same & also(j) if also else same

    return F.when(last >= first, F.filter(F.sequence(first, last), fits)).otherwise(F.array().cast("array<int>"))


def matches(docs: DataFrame, items: DataFrame, kinds: tuple[str, ...] = (TEMPLATE, WORDS), text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", least_words: int = 1) -> DataFrame:
    """doc_id, text_hash, item_id, kind, n_windows (agreeing pairs of places) for every document that holds an item.

    Windows of both kinds and of all lengths leave a text in one pass. `least_words` leaves out items of fewer words.
    """
    d = prepared(docs, text, key).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    i = items.select(F.col(item_key).alias("item_id"), F.col(item_text).cast("string").alias("item")).distinct()
    made = {TEMPLATE: (tokens, values, LEAST), WORDS: (plain_words, plain_words, max(1, least_words))}
    parts = [i.select("item_id", F.lit(k).alias("kind"), made[k][0](F.col("item")).alias("it"), made[k][1](F.col("item")).alias("iv")).withColumn("n", F.least(F.lit(RUN), F.size("it"))).where(F.col("n") >= made[k][2]) for k in kinds]
    i = reduce(DataFrame.unionAll, parts)
    short = i.where(F.col("n") < RUN).select("kind", "n").distinct().orderBy("kind", "n").collect()  # at most RUN - 1 lengths a kind

    length = F.when(F.col("n") < RUN, F.col("n")).otherwise(SEED)
    own = reduce(DataFrame.unionAll, [i.where(F.col("kind") == k).select("item_id", "kind", length.alias("length"), F.explode(seeds(k, F.col("it"), length, 1)).alias("w")) for k in kinds])
    own = own.select("item_id", "kind", F.col("w.at").alias("item_at"), F.col("w.hash").alias("hash"))
    toks = {k: made[k][0](F.col("text")).alias(k) for k in kinds}
    sets = [seeds(k, F.col(k), SEED, STRIDE) for k in kinds] + [seeds(r["kind"], F.col(r["kind"]), r["n"], 1) for r in short]
    found = d.select("doc_id", "text_hash", *toks.values()).select("doc_id", "text_hash", F.explode(F.concat(*sets)).alias("w"))
    lines = found.select("doc_id", "text_hash", F.col("w.at").alias("doc_at"), F.col("w.hash").alias("hash")).join(own, "hash")
    lines = lines.select("doc_id", "text_hash", "item_id", "kind", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    lines = written(lines, "shared-windows")  # used twice, and costs a pass over all texts

    marked = lines.select("doc_id", "text_hash").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])
    hit = d.join(marked, same(d, marked), "left_semi").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    hit = hit.select("doc_id", "text_hash", *toks.values(), values(F.col("text")).alias("dv"))
    pairs = lines.alias("l").join(hit.alias("h"), F.col("l.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("l.text_hash") == F.col("h.text_hash")))
    pairs = pairs.select("l.doc_id", "l.text_hash", "l.item_id", "l.kind", "shift", "dv", *kinds).join(i, ["item_id", "kind"])
    n, shift, it = F.col("n"), F.col("shift"), F.col("it")
    slots = lambda j: slots_answer(F.slice(it, j + 1, n), F.slice("iv", j + 1, n), F.slice("dv", j + shift + 1, n))
    at = {TEMPLATE: lambda: places(F.col(TEMPLATE), it, shift, n, slots), WORDS: lambda: places(F.col(WORDS), it, shift, n)}
    at = reduce(lambda out, k: F.when(F.col("kind") == k, at[k]()).otherwise(out), kinds, F.array().cast("array<int>"))
    return (pairs.select("doc_id", "text_hash", "item_id", "kind", F.size(at).cast("long").alias("n_windows")).where("n_windows > 0")
            .groupBy("doc_id", "text_hash", "item_id", "kind").agg(F.sum("n_windows").alias("n_windows")))


def leaks(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """doc_id, text_hash, item_id, n_windows of the documents that hold an item's template."""
    return matches(docs, items, (TEMPLATE,), **names).drop("kind")


def copies(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """The columns of `leaks` for every document that holds RUN words of an item in a row as they stand, or all words of a shorter item."""
    return matches(docs, items, (WORDS,), **names).drop("kind")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", exact: bool = False, least_words: int = 2) -> DataFrame:
    """`docs` without those that hold an item; `exact`: by its template or by its words as they stand.

    An item of fewer than `least_words` words drops nothing by its words: it would take every text with that word.
    """
    found = matches(docs, items, (TEMPLATE, WORDS) if exact else (TEMPLATE,), text, key, least_words=least_words)
    bad = found.select("doc_id", "text_hash").distinct().withColumnsRenamed({"doc_id": "bad_id", "text_hash": "bad_hash"})
    rows = boxed(docs, text, key).join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_hash")), "left_anti")
    return unboxed(rows, docs, text)


def oracle(least: int = LEAST, run: int = RUN) -> str:
    """The same by plain windows of the full length at every token, in DuckDB SQL."""

    def canon(c: str) -> str:
        x = f"regexp_replace(coalesce({c}, ''), '(^|[^\\p{{L}}\\p{{N}}])\\p{{Lu}}[\\p{{L}}-]*', '\\1{NAME}', 'g')"
        x = f"regexp_replace({x}, '{NUMBER}', '{NUM}', 'g')"
        x = f"regexp_replace({x}, '(?i){NUM}(\\s*)(?:{UNITS})\\b', '{NUM}\\1{UNIT}', 'g')"
        return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}\\s{MARKS}]', '', 'g')"

    def toks(c: str) -> str:
        plain = f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')"
        return f"list_filter(list_zip(string_split_regex({canon(c)}, '\\s+'), string_split_regex({plain}, '\\s+')), lambda x: x[1] <> '')"

    words = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '')"

    def windows(name: str, of: str) -> str:
        return f"""{name}d as (select doc_id, {of} z from documents),
  {name}n as (select item_id, z, least({run}, len(z)) n from (select item_id, {of} z from benchmark) where len(z) >= {least if name == 't' else 1}),
  {name}i as (select item_id, n, unnest(list_transform(range(1, len(z) - n + 2), lambda j: z[j:j + n - 1])) w from {name}n),
  {name}w as (select doc_id, l.n, unnest(list_transform(range(1, len(z) - l.n + 2), lambda j: z[j:j + l.n - 1])) w from {name}d, (select distinct n from {name}n) l where len(z) >= l.n)"""

    return f"""
with {windows('t', toks('text'))},
a as (select item_id, n, w, list_aggregate(list_transform(w, lambda x: x[1]), 'string_agg', ' ') t from ti),
b as (select doc_id, n, w, list_aggregate(list_transform(w, lambda x: x[1]), 'string_agg', ' ') t from tw),
p as (select doc_id, item_id, a.n, list_filter(list_zip(list_transform(a.w, lambda x: x[1]), list_transform(a.w, lambda x: x[2]), list_transform(b.w, lambda x: x[2])), lambda x: regexp_matches(x[1], '[{MARKS}]')) s
      from a join b on a.t = b.t and a.n = b.n),
l as (select doc_id, item_id, count(*) n_windows from p
      where len(list_filter(s, lambda x: x[2] <> x[3])) = 0 or (2 * len(s) <= n and len(list_distinct(list_transform(s, lambda x: {{'x': x[2], 'y': x[3]}}))) = len(list_distinct(list_transform(s, lambda x: x[2])))
        and len(list_distinct(list_transform(s, lambda x: {{'x': x[2], 'y': x[3]}}))) = len(list_distinct(list_transform(s, lambda x: x[3]))))
      group by doc_id, item_id),
{windows('w', words)},
c as (select doc_id, item_id, count(*) n_copies from wi join ww on wi.n = ww.n and list_aggregate(wi.w, 'string_agg', ' ') = list_aggregate(ww.w, 'string_agg', ' ') group by doc_id, item_id)
select coalesce(l.doc_id, c.doc_id) doc_id, coalesce(l.item_id, c.item_id) item_id, coalesce(n_windows, 0) n_windows, coalesce(n_copies, 0) n_copies from l full join c on l.doc_id = c.doc_id and l.item_id = c.item_id"""
