"""Near copies by BagMinHash over bags of word shingles.

A text is the bag of its five-word shingles (lower case, words between white space; a shorter text is one shingle).
Weighted Jaccard similarity of two bags is the sum of the smaller counts over the sum of the larger ones.

Signature: the weight axis is cut into levels [0, 1), [1, 2), [2, 4), [4, 8) and so on. In each level a shingle has
a Poisson process of its own, seeded by its hash; every point has a time, a weight and a component. A text sees the
points below its count. The earliest point it sees in a component is that component's value, so two texts agree in
a component with a chance of exactly their weighted Jaccard similarity. Points later than a text's horizon are not
generated; where a component stayed empty, the horizon is doubled.

Classes: equal texts are one node. BANDS bands of ROWS components each give buckets (a pair at 0.8 shares one but
for a chance of 5e-6). Within a bucket all are compared to its most central member. Buckets whose members then
still are in several classes are compared in blocks of at most BLOCK by BLOCK, across classes only: on signatures,
and on the bags where those are near. Every link is checked on the bags themselves. Classes are connected components, found by Spark in rounds.

Null and empty texts have no shingles: each such row is a class of its own. Rows with equal texts share a class;
a class has the smallest doc_id of its rows as id, or null if all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from reelspark.llm.common import boxed, map_rows, prepared, release, unboxed, written

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 40, 6
SIZE = BANDS * ROWS
BLOCK = 128
#: Estimates below this are no links: 0.8 less five standard deviations of an estimate (a chance of 3e-7, below that of the bands).
ESTIMATE = LEAST - 5 * (LEAST * (1 - LEAST) / SIZE) ** 0.5
#: Words that a task remembers, and the longest of them.
MEMORY, REMEMBERED = 120_000, 64
#: Shingles whose points are made at a time.
SLICE = 1 << 16
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * _B
    h = (h ^ h >> np.uint64(27)) * _C
    return h ^ h >> np.uint64(31)


class Shingler:
    """Bags of a list of texts in one row: text number, shingle hash, count."""

    def __init__(self):
        self.memory: dict[str, int] = {}

    def word(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        if len(w) <= REMEMBERED:
            self.memory[w] = h
        return h

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.memory) > MEMORY:
            self.memory = {}
        get = self.memory.get
        rows = []
        for t in texts:
            words = t.lower().split()
            if 0 < len(words) < WORDS:
                words = [" ".join(words)]  # one shingle; its hash is that of no single word of a longer text
                rows.append(np.array([self.word(words[0]) ^ 1], np.uint64))
            else:
                h = np.fromiter([x if (x := get(w)) is not None else self.word(w) for w in words], np.uint64, len(words))
                rows.append(h)
        lens = np.array([len(r) for r in rows], np.int64)
        flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
        n = len(flat)
        owner = np.repeat(np.arange(len(rows)), lens)
        short = np.repeat(lens == 1, lens)
        h = np.zeros(max(0, n), np.uint64)
        for i in range(WORDS):
            part = np.append(flat[i:], np.zeros(min(i, n), np.uint64))
            h = mix(h * _A + part)
        at = np.arange(n) - np.repeat(np.cumsum(lens) - lens, lens)
        whole = at + WORDS <= np.repeat(lens, lens)
        h = np.where(short, mix(flat + _A), h)
        keep = whole | short
        h, owner = h[keep], owner[keep]
        by = np.lexsort((h, owner))
        h, owner = h[by], owner[by]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, int)
        return owner[first], h[first], np.diff(np.append(first, len(h)))


def points(h: np.ndarray, level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and uniform number in (0, 1] of the k-th point of each process."""
    x = mix(h + _A * (level.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(k + 1)))
    return x, ((x >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)


def signatures(owner: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """n x SIZE times of the earliest points; infinite for texts without shingles."""
    out = np.full((n, SIZE), np.inf)
    if not len(h):
        return out
    total = np.bincount(owner, count, n)
    horizon = SIZE * (np.log(SIZE) + 6) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        for at in range(0, len(h), SLICE):
            o, x, c = (a[at : at + SLICE] for a in (owner, h, count))
            on = todo[o]
            if on.any():
                earliest(out.reshape(-1), o[on], x[on], c[on], horizon)
        todo &= np.isinf(out).any(1)
        horizon = np.where(todo, horizon * 2, horizon)
        out[todo] = np.inf
    return out


def earliest(out: np.ndarray, owner: np.ndarray, h: np.ndarray, count: np.ndarray, horizon: np.ndarray) -> None:
    """Lowers the times in `out` (owner by component) to those of these shingles' points before the owners' horizons."""
    levels = np.ceil(np.log2(count)).astype(int) + 1  # levels 0 to levels - 1 have points below the count
    o, x, c = np.repeat(owner, levels), np.repeat(h, levels), np.repeat(count, levels)
    lv = np.arange(len(o)) - np.repeat(np.cumsum(levels) - levels, levels)
    lo = np.where(lv > 0, 2.0 ** (lv - 1), 0.0)
    w = np.where(lv > 0, lo, 1.0)
    t, limit, k = np.zeros(len(o)), horizon[o], 0
    while len(o):
        bits, u = points(x, lv, k)
        t = t - np.log(u) / w
        live = t <= limit
        o, x, lv, c, lo, w, t, limit, bits = (a[live] for a in (o, x, lv, c, lo, w, t, limit, bits))
        more = mix(bits + _C)
        weight = lo + w * ((more >> np.uint64(40)).astype(np.float64) / (1 << 24))
        seen = weight < c
        np.minimum.at(out, o[seen] * SIZE + (more[seen] & np.uint64(0xFFFFFFFF)).astype(np.int64) % SIZE, t[seen])
        k += 1


def packed(times: np.ndarray) -> np.ndarray:
    """16 bits of each value; equal times are the same point."""
    return (mix(times.view(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def sign(docs: DataFrame) -> DataFrame:
    """Adds the signature of each text; null for a text without words. Works on about 1 MB of text at a time."""

    def make():
        shingle = Shingler()

        def run(texts: list[str]) -> dict[str, list]:
            owner, h, count = shingle(texts)
            times = signatures(owner, h, count, len(texts))
            empty = np.isinf(times[:, 0])
            return {"signature": [None if e else s.tobytes() for s, e in zip(packed(times), empty.tolist(), strict=True)]}

        return run

    return map_rows(docs, "text", [T.StructField("signature", T.BinaryType())], make, most=1 << 20)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags of sorted hashes and counts."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = np.minimum(a[1][same], b[1][at[same]]).sum()
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose bags are at least that similar."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        last: tuple[bytes | None, tuple] = (None, ())

        def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
            _, h, count = shingle([text])
            return h, count

        for batch in batches:
            good = []
            for i in range(len(batch)):
                b = batch.column(1)[i].as_py()
                if last[0] != b:  # rows come ordered by b from the join
                    last = (b, bag(batch.column(3)[i].as_py()))
                good.append(similarity(bag(batch.column(2)[i].as_py()), last[1]) >= least)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        release()

    return rows.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, class): the smallest node of each connected component, for all nodes with an edge.

    Rounds of taking the neighbours' smallest label and then that label's own label, each written to the
    shared folder, until none changes.
    """
    both = written(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("class")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy("a").agg(F.min("class").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "class", F.least("class", "near").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = written(step.join(jump, "next").select("node", F.col("class").alias("old"), F.least("next", "far").alias("class")), "labels")
        changed = after.where("old <> class").limit(1).count()
        labels = after.select("node", "class")
        if not changed:
            return labels


def within_blocks(members: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links between members of a bucket (key, band, node, class) that are in different classes.

    The members outside a bucket's largest class meet all its members, block by block. A pair whose signatures
    agree enough is compared on its bags where it stands, in the first of the bands that it shares; only links leave
    the task.
    """
    each = members.groupBy("key", "class").agg(F.count("*").alias("n"))
    keys = each.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("classes")).where("classes > 1")
    keys = keys.select("key", F.col("top.class").alias("most"), F.ceil(F.col("all") / BLOCK).cast("int").alias("n_all"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("n_rest"))
    rows = members.join(keys, "key").withColumn("at", F.xxhash64("node"))
    own = rows.where(F.col("class") != F.col("most")).select("key", "band", "node", "class", F.pmod("at", "n_rest").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), F.lit(True).alias("rest"))
    other = rows.select("key", "band", "node", "class", F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)).alias("i"), F.pmod("at", "n_all").cast("int").alias("j"), F.lit(False).alias("rest"))
    full = nodes.select("node", "signature").join(texts, "node")
    rows = own.unionAll(other).join(full, "node").select("key", "band", "i", "j", "node", "class", "rest", "signature", "text")

    def compare(table: pa.Table) -> pa.Table:
        rest = table.column("rest").to_numpy(zero_copy_only=False)
        node, label = table.column("node").to_pylist(), table.column("class").to_pylist()
        number = {c: i for i, c in enumerate(set(label))}
        label = np.array([number[c] for c in label])
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u2").reshape(len(node), SIZE)
        band, text, shingle = table.column("band")[0].as_py(), table.column("text"), Shingler()
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in bags:
                bags[i] = shingle([text[i].as_py()])[1:]
            return bags[i]

        x, y = np.flatnonzero(rest), np.flatnonzero(~rest)
        found: list[tuple[bytes, bytes]] = []
        for i in x.tolist():
            same = sig[y] == sig[i]
            near = (same.mean(1) >= ESTIMATE) & (label[y] != label[i])
            first = same[near].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
            for j in y[near][first].tolist():
                if similarity(bag(i), bag(j)) >= least:
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def classes(docs: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_hash (MD5, binary), class_hash (null for a row without words) and class_id of every row."""
    base = prepared(docs, text, key).withColumn("node", F.unhex(F.md5("text")))
    signed = written(sign(base).select("doc_id", "node", "signature"), "signatures")
    full = signed.where("signature is not null")
    nodes = written(full.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature")), "nodes")
    own = lambda b: F.xxhash64(b, F.substring("signature", b * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    bands = nodes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), own)).alias("band", "key"))
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(bands.join(sizes, "key"), "buckets")
    central = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = shared.join(central, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("b"))
    stars = written(shared.select("key", F.col("node").alias("a")).join(hubs, "key").where("a <> b").select("a", "b").distinct(), "pairs")
    wanted = shared.select("node").distinct()
    texts = written(base.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    links = written(verified(stars, texts, least), "links")
    members = shared.select("key", "band", "node").join(components(links), "node", "left").select("key", "band", "node", F.coalesce("class", "node").alias("class"))
    more = written(within_blocks(members, nodes, texts, least), "links")
    found = components(links.unionAll(more))
    named = nodes.select("node", "first_id").join(found, "node", "left").select("node", "first_id", F.coalesce("class", "node").alias("class"))
    ids = named.join(named.groupBy("class").agg(F.min("first_id").alias("class_id")), "class").select("node", "class", "class_id")
    some = full.select("doc_id", "node").join(ids, "node").select("doc_id", "node", "class", "class_id")
    none = signed.where("signature is null").select("doc_id", "node", F.lit(None).cast("binary").alias("class"), F.col("doc_id").alias("class_id"))
    return some.unionAll(none).select("doc_id", F.col("node").alias("text_hash"), F.col("class").alias("class_hash"), "class_id")


def one_of_each(docs: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`docs` with one row of each class: the one with the smallest id (nulls last), then the smallest text hash.

    Rows without words all stay. Of rows that repeat id and text one stays, with other columns of any of them.
    """
    found = written(classes(docs, least, text, key).where("class_hash is not null"), "classes")
    best = found.groupBy("class_hash").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    rows = found.groupBy("doc_id", "text_hash").agg(F.first("class_hash").alias("class_hash"), F.count("*").alias("n")).join(best, "class_hash")
    stays = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.text_hash") == F.col("text_hash"))
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.when(~stays, "drop").when(F.col("n") > 1, "many").alias("_fate")).where("_fate is not null")
    rows = written(rows, "fates").hint("merge")  # grows with the documents: the same plan at every size
    joined = boxed(docs, text, key).join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.unhex(F.md5("text")) == F.col("_hash")), "left")
    kept = joined.where("_fate is null").select("doc_id", "text", "row")
    if rows.where("_fate = 'many'").limit(1).count():
        kept = kept.unionAll(joined.where("_fate = 'many'").select("doc_id", "text", "row").dropDuplicates(["doc_id", "text"]))
    return unboxed(kept, docs, text)


def oracle(least: str = "0.8") -> str:
    """Classes by plain comparison of all texts that share a shingle, in DuckDB SQL."""
    return f"""
with recursive w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') w from documents),
g as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < {WORDS} then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) end) s from w),
b as (select doc_id, s, count(*) n from g group by all),
t as (select doc_id, sum(n) total from b group by 1),
o as (select x.doc_id a, y.doc_id b, sum(least(x.n, y.n)) common from b x join b y on x.s = y.s and x.doc_id < y.doc_id group by all),
e as (select a, b from o join t ta on ta.doc_id = a join t tb on tb.doc_id = b where common >= {least} * (ta.total + tb.total - common)),
pairs as (select a, b from e union all select b, a from e),
reach as (select doc_id, doc_id root from documents union select pairs.b, root from reach join pairs on pairs.a = reach.doc_id)
select doc_id, min(root) class_id from reach group by 1"""
