"""Divergence of sources within a language, priced on hash-consed segment trees.

Terms are runs of letters and of characters beyond ASCII, A to Z in lower case. A language keeps the terms that stand
in at least LEAST of its documents. A group is a (language, source); a group with N occurrences of V kept terms gives
a term with n occurrences p = 1 + floor(SCALE * (n + 1) / (N + V)). How far a group is from another is the sum over
all kept terms of floor((p - q)^2 / q).

Counting: tasks sum terms for each group and hand on what they have as it fills up, Spark adds that up by (language,
term), so a frequent term comes as a few rows of each task.

Pairs of groups: the terms of a language are cut by hash into segments of about SEGMENT terms, its sources into blocks
of BLOCK; one task holds one segment for two blocks. There each group becomes a segment tree over the term ids, built
level by level: nodes with equal children are one node, shared by all groups. Two trees are walked together
from the roots; equal pairs of nodes are followed once, with a number, so at the leaves each pair of counts is priced
once. Term ids follow the counts, so that equal subtrees are many. Sums of segments are added by Spark.

All arithmetic is exact in 64 bits: fractions by long division in base 1000 (N + V below 9e15), squares below 1e18.

Nulls in text, language or source count as ''. Rows that repeat count each time. Groups without terms have all pairs
as well; a language without kept terms gives them the value 0. Ties are ranked by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from reelspark.llm.common import pieces, written

LEAST, SCALE, SHOWN = 3, 1_000_000_000, 200
SEGMENT, BLOCK = 8192, 64
#: Terms of groups that a task holds before it hands them on, and characters of text it sums up at most until then.
HELD, HELD_TEXT = 400_000, 64 << 20
#: Pairs of groups that are walked at a time.
AT_ONCE = 64
# Bytes that are no term, and A to Z.
_TABLE = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df (documents of the group with it) in parts; a row with term '' for every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple[str, str], Counter] = {}
        df: dict[tuple[str, str], Counter] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in n.items():
                other = df[lang, source]
                items = list(own.items())
                for at in range(0, len(items), 50_000):
                    part = items[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array([t for t, _ in part], pa.binary()).cast(pa.string()),
                         pa.array([c for _, c in part], pa.int64()), pa.array([other[t] for t, _ in part], pa.int64())], names=["lang", "source", "term", "n", "df"])

        for batch in batches:
            for i, j in pieces(batch.column(0), 1 << 20):
                part = batch.slice(i, j - i)
                for text, lang, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    group = lang, source
                    if group not in n:
                        n[group], df[group] = Counter({b"": 0}), Counter()
                    words = text.encode().translate(_TABLE).split()
                    n[group].update(words)
                    df[group].update(set(words))
                    size += len(text)
                if size > HELD_TEXT or sum(map(len, n.values())) > HELD:
                    yield from told()
                    n, df, size = {}, {}, 0
        yield from told()

    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return texts.mapInArrow(run, "lang string, source string, term string, n long, df long")


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total) by long division, three digits at a time."""
    rest, out = n + 1, F.lit(0).cast("long")
    whole = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + whole(rest, total)
        rest = rest % total
    return out + 1


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    rest, out = n + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


class Trees:
    """Segment trees of several groups over the same term ids, as rows of a matrix of counts; equal nodes are one."""

    def __init__(self, counts: np.ndarray):
        groups, terms = counts.shape
        wide = 1 << max(0, (terms - 1).bit_length())
        self.leaves, at = np.unique(counts, return_inverse=True)
        level = np.full((groups, wide), -1, np.int64)  # -1: no term
        level[:, :terms] = at.reshape(counts.shape)
        level += 1
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        while level.shape[1] > 1:
            many = int(level.max()) + 1
            nodes, at = np.unique(level[:, ::2] * many + level[:, 1::2], return_inverse=True)
            self.left.append(nodes // many)
            self.right.append(nodes % many)
            level = at.reshape(groups, -1)
        self.roots = level[:, 0]

    def walk(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of trees from their roots to pairs of leaf counts: pair number, both counts, how often."""
        pair, times = np.arange(len(x)), np.ones(len(x), np.int64)
        for left, right in zip(reversed(self.left), reversed(self.right), strict=True):
            many = int(max(left.max(), right.max())) + 1
            key = np.concatenate([(pair * many + left[x]) * many + left[y], (pair * many + right[x]) * many + right[y]])
            key, at = np.unique(key, return_inverse=True)
            times = np.bincount(at, np.concatenate([times, times]), len(key)).astype(np.int64)  # at most SEGMENT: exact
            pair, x, y = key // many // many, key // many % many, key % many
        real = x > 0
        return pair[real], self.leaves[x[real] - 1], self.leaves[y[real] - 1], times[real]


def priced(counts: np.ndarray, total: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Divergence of groups a from groups b and of b from a; `counts` is groups x terms, `total` each group's N + V."""
    there, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    if not counts.shape[1]:
        return there, back
    trees = Trees(counts)
    roots = trees.roots
    for at in range(0, len(a), AT_ONCE):
        own, other = a[at : at + AT_ONCE], b[at : at + AT_ONCE]
        pair, m, n, times = trees.walk(roots[own], roots[other])
        p, q = _share(m, total[own][pair]), _share(n, total[other][pair])
        square = (p - q) ** 2
        np.add.at(there, at + pair, square // q * times)
        np.add.at(back, at + pair, square // p * times)
    return there, back


def _price(table: pa.Table) -> pa.Table:
    """One segment for two blocks of sources: rows of groups (h1 null, h2 the segment's terms, n the total) and of their terms' counts."""
    col = lambda c: table.column(c).to_numpy(zero_copy_only=False)
    head = table.column("h1").is_null().to_numpy()
    i, j, block = table.column("i")[0].as_py(), table.column("j")[0].as_py(), col("block")
    at, n = col("at"), col("n")
    order = np.argsort(at[head], kind="stable")
    groups, total, of = at[head][order], n[head][order], block[head][order]
    terms = table.filter(pa.array(~head))
    h = np.stack([terms.column(c).to_numpy() for c in ("h1", "h2")]).astype(np.int64)
    _, term = np.unique(h, axis=1, return_inverse=True)
    term = term.reshape(-1)
    counts = np.zeros((len(groups), int(col("h2")[head][0])), np.int64)  # terms that are in other blocks only have zeros
    counts[np.searchsorted(groups, at[~head]), term] = n[~head]
    weight = np.random.default_rng(3).integers(1, 1 << 62, len(groups)).astype(np.uint64)
    mark = (counts.astype(np.uint64) * weight[:, None]).sum(0, dtype=np.uint64)  # equal columns stand together
    counts = counts[:, np.lexsort((mark, counts.sum(0)))]
    x, y = np.flatnonzero(of == i), np.flatnonzero(of == j)
    a, b = (g.ravel() for g in np.meshgrid(x, y, indexing="ij"))
    if i == j:
        a, b = a[a < b], b[a < b]
    there, back = priced(counts, total, a, b)
    lang = pa.array([table.column("lang")[0].as_py()] * (2 * len(a)), pa.string())
    return pa.table({"lang": lang, "a": pa.array(np.concatenate([groups[a], groups[b]])), "b": pa.array(np.concatenate([groups[b], groups[a]])), "value": pa.array(np.concatenate([there, back]))})


def audit(docs: DataFrame, least: int = LEAST, shown: int = SHOWN) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank of every group."""
    by_term = Window.partitionBy("lang", "term")
    summed = counted(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    summed = summed.withColumns({"docs": F.sum("df").over(by_term), "lang_n": F.sum("n").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1})
    kept = written(summed.where((F.col("term") == "") | (F.col("docs") >= least)).drop("df", "docs"), "terms")
    terms = kept.where("term <> ''")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count_if(F.col("first") & (F.col("term") != "")).alias("v"))
    by_lang = Window.partitionBy("lang")
    totals = totals.withColumns({"v": F.sum("v").over(by_lang), "lang_own": F.sum("own").over(by_lang), "sources": F.count("*").over(by_lang), "at": F.row_number().over(by_lang.orderBy("source")) - 1})
    block = F.floor(F.col("at") / BLOCK).cast("int").alias("block")
    totals = written(totals.select("lang", "source", "at", block, F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks"), (F.col("own") + F.col("v")).alias("total"), (F.col("lang_own") + F.col("v")).alias("lang_total"),
                                   F.greatest(F.lit(1), F.ceil(F.col("v") / SEGMENT)).cast("int").alias("segments")), "groups")

    both = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    h = F.xxhash64("term")
    segment = lambda own, many: F.pmod(own, many).cast("int").alias("segment")
    sizes = terms.where("first").join(totals.select("lang", "segments").distinct(), "lang").groupBy("lang", segment(h, F.col("segments"))).agg(F.count("*").alias("size"))
    heads = totals.select("lang", "at", "block", F.col("total").alias("n"), F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"), "blocks").join(sizes, ["lang", "segment"], "left")
    heads = heads.select("lang", "at", "block", F.lit(None).cast("long").alias("h1"), F.coalesce("size", F.lit(0)).cast("long").alias("h2"), "n", "segment", "blocks")
    rows = terms.join(totals, ["lang", "source"]).select("lang", "at", "block", h.alias("h1"), F.xxhash64(F.lit(1), "term").alias("h2"), "n", segment(h, F.col("segments")), "blocks")
    rows = heads.unionAll(rows).select("lang", "segment", "at", "block", "h1", "h2", "n", both)
    rows = rows.select("lang", "segment", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "at", "block", "h1", "h2", "n")
    sums = rows.groupBy("lang", "segment", "i", "j").applyInArrow(_price, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = totals.select("lang", F.col("at").alias("a"), "source")
    pairs = sums.join(names, ["lang", "a"]).join(names.select("lang", F.col("a").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    each = terms.join(totals, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q"))
    far = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    each = each.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), far.alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    return ranked(pairs).unionAll(ranked(each).where(F.col("rank") <= shown))


def oracle(least: int = LEAST, shown: int = SHOWN) -> str:
    """The same term by term for every pair of groups, in DuckDB SQL."""
    low, high = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = lambda n, total: f"1 + ({SCALE} * ({n} + 1)::HUGEINT) // ({total})"
    f = "(((p - q) * (p - q)) // q)"
    return f"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') text from documents),
g as (select distinct lang, source from d),
w as (select id, lang, source, unnest(regexp_extract_all(translate(text, '{high}', '{low}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
k as (select lang, term, count(*) n from w group by all having count(distinct id) >= {least}),
c as (select w.lang, source, term, count(*) n from w join k using (lang, term) group by all),
v as (select lang, count(*) v, sum(n) total from k group by 1),
t as (select g.lang, g.source, coalesce(sum(n), 0) + coalesce(any_value(v), 0) total from g left join c using (lang, source) left join v on v.lang = g.lang group by all),
s as (select t.lang, t.source, term, {p('coalesce(c.n, 0)', 't.total')} p, coalesce(c.n, 0) n from t join k using (lang) left join c using (lang, source, term)),
x as (select a.lang, a.source, b.source item, sum((((a.p - b.p) * (a.p - b.p)) // b.p)) as value from s a join s b using (lang, term) where a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(x.value, 0)::BIGINT as value from g a join g b on a.lang = b.lang and a.source <> b.source left join x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' part, term item, {f}::BIGINT as value from (select s.lang, s.source, term, p, s.n own, {p('k.n', 'v.total + v.v')} q from s join k using (lang, term) join v using (lang)) where own > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::INTEGER as rank from r where part = 'pair' or rank <= {shown}"""
