"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a LENGTH-byte string that also starts anywhere else goes. Suffix arrays are built shard by
shard, so strings that may be equal first have to meet in one shard:

1. Each window of LENGTH bytes is filed under the smallest hash of the k-byte strings in it. Equal windows have equal
   keys; neighbouring windows of one key form a region. A key that stands in one region alone, once, holds no repeat.
2. Regions of equal bytes are one region with a count; from a count of two on all its windows repeat.
3. Groups of regions are packed into shards of about SHARD bytes. A shard's suffix array comes from induced sorting,
   its permuted common prefixes tell which windows stand in it twice.
4. A group of more than GROUP bytes, as around a passage in very many documents, has one k-byte string in all its
   windows: a window is what it takes on either side of the first one in it. Such windows are counted distance by
   distance, all regions abreast, and all places of a region where the string stands again, as in repeated lines.
5. A group of more than HOT bytes or PLACES places isn't gathered: its regions are cut again by longer k-byte strings,
   up to the whole window, where a group is one string and a count.

All windows are covered at any size; nothing is sampled. Null text counts as empty, texts under LENGTH bytes keep
everything. Equal texts are taken up once, with their number.

A passage of WORDS words may be shorter than LENGTH bytes and then stays. `shared_passages` counts those that a document
shares with another one: strings of words are filed in the same way, and those whose key stands in two texts are told by
their hashes of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from reelspark.llm.common import map_rows, pieces, prepared, written

LENGTH = 400
#: Bytes of the hashed strings, level by level, as parts of a window; the last is the window.
PARTS = (0.12, 0.5, 0.8, 0.95, 1.0)
SHARD, GROUP, HOT, PLACES = 1 << 20, 1 << 19, 32 << 20, 1 << 18
#: Shards' partitions, in parts of the session's; shards cost time by their bytes.
SPREAD = 4
#: Windows of a text that are hashed at a time.
SEGMENT = 1 << 20
#: Words of a passage that documents are told to share, and of the strings under which it is filed.
WORDS, ANCHOR = 51, 12
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)

_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[0] = 1
    return np.cumprod(x, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Filer:
    """Cuts texts into regions: runs of windows whose smallest hash of k symbols is the same. Symbols are bytes or codes of 64 bits."""

    def __init__(self, length: int, k: int):
        self.length, self.k, self.n = length, k, 0

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 1 << 14)
            self.up, self.down = _powers(_P, self.n + 1), _powers(_INV, self.n + 1)

    def hashes(self, data: np.ndarray, k: int) -> np.ndarray:
        """Of each string of k symbols."""
        n = len(data)
        self.grow(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * self.up[:n], out=sums[1:])
        return _mix((sums[k:] - sums[:-k]) * self.down[: n - k + 1])

    def part(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, first window, window after, at how many places windows meet the key first, and the first of them from the region's first byte."""
        wide = self.length - self.k + 1
        h = self.hashes(data, self.k)
        windows = len(data) - self.length + 1
        x = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
        if wide > 1:
            x = np.append(x, np.full(-len(x) % wide, np.iinfo(np.uint64).max)).reshape(-1, wide)
            ahead = np.minimum.accumulate(x, 1).reshape(-1)
            back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].reshape(-1)
            x = np.minimum(back[:windows], ahead[wide - 1 : wide - 1 + windows])
        place = (x[:windows] & np.uint64((1 << 21) - 1)).astype(np.int64)
        key = h[place]
        moves = place[1:] != place[:-1]
        cut = key[1:] != key[:-1]
        first = np.append(0, np.flatnonzero(cut) + 1)
        after = np.append(first[1:], windows)
        moved = np.cumsum(np.append(0, moves & ~cut))
        return key[first].view(np.int64), first, after, moved[after - 1] - moved[first] + 1, place[first] - first

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        windows = len(data) - self.length + 1
        if windows < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = []
        for s in range(0, windows, SEGMENT):
            key, first, after, places, at = self.part(data[s : s + SEGMENT + self.length - 1])
            out.append((key, first + s, after + s, places, at))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# Induced sorting.


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol is the one smallest sentinel."""
    n = len(s)
    differs = np.append(s[1:] != s[:-1], True)
    nearest = np.flatnonzero(differs)[np.searchsorted(np.flatnonzero(differs), np.arange(n))]
    small = np.append(s[:-1] < s[1:], True)
    return small[nearest]


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """Sorts all suffixes from leftmost-smaller ones in order, bucket by bucket, for a small alphabet."""
    left: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    right: list[list[np.ndarray]] = [[] for _ in range(sigma)]

    def deal(front: np.ndarray, c: int, to: list[list[np.ndarray]], larger: bool) -> np.ndarray:
        """Puts the predecessors of `front` that are of this pass into their buckets; those of bucket c come back."""
        prev = front[front > 0] - 1
        prev = prev[small[prev] != larger]
        ch = s[prev]
        again = prev[ch == c]
        prev, ch = prev[ch != c], ch[ch != c]
        if len(prev):
            by = np.argsort(ch, kind="stable")
            prev, ch = prev[by], ch[by]
            cuts = np.flatnonzero(ch[1:] != ch[:-1]) + 1
            for x, p in zip(ch[np.append(0, cuts)].tolist(), np.split(prev, cuts), strict=True):
                to[x].append(p)
        return again

    ch = s[lms]
    seeds = np.split(lms[np.argsort(ch, kind="stable")], np.cumsum(np.bincount(ch, minlength=sigma))[:-1])
    for c in range(sigma):
        done = 0
        while done < len(left[c]):
            front = left[c][done] if done == len(left[c]) - 1 else np.concatenate(left[c][done:])
            done = len(left[c])
            if len(again := deal(front, c, left, True)):
                left[c].append(again)
        if len(seeds[c]):
            deal(seeds[c], c, left, True)
    # Larger suffixes are in place; the smaller ones come from the right, each bucket built backwards.
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in left]
    for c in range(sigma - 1, -1, -1):
        done = 0
        while done < len(right[c]):
            front = right[c][done] if done == len(right[c]) - 1 else np.concatenate(right[c][done:])
            done = len(right[c])
            if len(again := deal(front, c, right, False)):
                right[c].append(again)
        deal(joined[c][::-1], c, right, False)
    out = [np.array([len(s) - 1])]  # the sentinel has no successor to induce it
    for c in range(sigma):
        out.append(joined[c])
        if right[c]:
            out.append(np.concatenate(right[c])[::-1])
    return np.concatenate(out)


def _doubled(s: np.ndarray) -> np.ndarray:
    """Suffix array for an alphabet as large as the text: ranks of strings twice as long each round, of those still alike."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    at, key, rank, h = np.arange(n), s[sa], np.zeros(n, np.int64), 1
    while True:
        x = sa[at]
        first = np.append(True, key[1:] != key[:-1])
        rank[x] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        at = at[~(first & np.append(first[1:], True))]
        if not len(at):
            return sa
        x = sa[at]
        key = rank[x] * n + rank[x + h]  # strings of h symbols that are alike end before the last symbol
        order = np.argsort(key)
        sa[at], key = x[order], key[order]
        h *= 2


def suffix_array(s: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of symbols below `sigma`; the last symbol is 0 and stands nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    if sigma > 512:
        return _doubled(s)
    small = _types(s)
    lms = np.flatnonzero(np.append(False, small[1:] & ~small[:-1]))
    sa = _induce(s, small, lms, sigma)
    # Names of the leftmost-smaller substrings, equal ones alike.
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    end = np.append(lms[1:], n - 1)
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    at, to = order, end[number[order]]
    size = to - at
    same = size[1:] == size[:-1]
    live = np.flatnonzero(same)
    for k in range(int(size.max()) + 1 if len(size) else 0):
        live = live[size[live] >= k]
        if not len(live):
            break
        equal = s[at[live] + k] == s[at[live + 1] + k]
        same[live[~equal]] = False
        live = live[equal]
    name = np.append(0, np.cumsum(~same))
    reduced = np.zeros(len(lms), np.int64)
    reduced[number[order]] = name
    if name[-1] + 1 == len(lms):
        return sa if not len(lms) else _induce(s, small, order, sigma)
    return _induce(s, small, lms[suffix_array(reduced, int(name[-1]) + 1)], sigma)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Permuted common prefixes and, for each suffix, the one before it in order (-1 for the first).

    Where the symbols before a suffix and before its neighbour agree, its prefix is one shorter than the one of the
    suffix to its left; only the others are compared, eight symbols at a time. A prefix ends at a symbol 0.
    """
    n = len(s)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    i = np.arange(n)
    has = before >= 0
    fresh = np.ones(n, bool)
    inner = has & (i > 0) & (before > 0)
    fresh[inner] = (s[i[inner] - 1] != s[before[inner] - 1]) | (s[i[inner] - 1] == 0)
    at = np.flatnonzero(fresh & has)
    length = np.zeros(n, np.int64)
    # Eight bits of a symbol are enough: where symbols that differ by 256 could meet, one is beyond `room`.
    wide = np.append(s, np.full(8, 256)).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= (wide[k : k + n] & np.uint64(0xFF)) << np.uint64(8 * k)
    live, ahead = at, np.zeros(len(at), np.int64)
    zero = np.append(np.flatnonzero(s == 0), n)
    room = np.minimum(zero[np.searchsorted(zero, at)] - at, zero[np.searchsorted(zero, before[at])] - before[at])
    while len(live):
        a, b = live + ahead, before[live] + ahead
        inside = ahead < room
        x = np.where(inside, words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)], np.uint64(1))
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.where(low > 0, (np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)) // 8).astype(np.int64), 0))
        ahead = np.where(inside, np.minimum(ahead + same, room), ahead)
        done = (x != 0) | (ahead >= room)
        length[live[done]] = ahead[done]
        live, ahead, room = live[~done], ahead[~done], room[~done]
    reach = np.maximum.accumulate(np.where(fresh, i, -1))
    return np.where(has, np.maximum(length[reach] - (i - reach), 0), 0), before


def repeats(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region, which of its windows stand at two or more places in all of them."""
    lens = np.array([len(r) for r in regions])
    starts = np.append(0, np.cumsum(lens + 1))[:-1]
    s = np.zeros(int((lens + 1).sum()) + 1, np.int64)
    for r, at in zip(regions, starts.tolist(), strict=True):
        s[at : at + len(r)] = np.frombuffer(r, np.uint8)
        s[at : at + len(r)] += 2
        s[at + len(r)] = 1  # between regions
    s[-1] = 0
    sa = suffix_array(s, 258)
    prefix, before = common_prefixes(np.where(s < 2, 0, s - 1), sa)
    long = np.flatnonzero(prefix >= length)
    mark = np.zeros(len(s), bool)
    mark[long] = mark[before[long]] = True
    return [mark[a : a + n - length + 1] for a, n in zip(starts.tolist(), lens.tolist(), strict=True)]


def beside(regions: list[bytes], at: np.ndarray, length: int, k: int) -> list[np.ndarray]:
    """The marks of `repeats` for regions that all hold one string of k bytes, first at `at`, in each of their windows.

    A window is told by the bytes it has before and after the first such string in it, hashed for one length after the other.
    """
    if not regions:
        return []
    room, size = length - k, np.array([len(r) for r in regions])
    own = regions[0][at[0] : at[0] + k]
    places = []
    for r, a in zip(regions, at.tolist(), strict=True):
        found = []
        while 0 <= a:
            found.append(a)
            a = r.find(own, a + 1)
        places.append(found)
    many = np.array([len(p) for p in places])
    region, at = np.repeat(np.arange(len(regions)), many), np.array([a for p in places for a in p], np.int64)
    before = np.append(-1, at[:-1])
    before[np.append(0, np.cumsum(many)[:-1])] = -1
    low, high = np.maximum(at - (size - length)[region], 0), np.minimum(at - before - 1, room)  # bytes before the string in the windows that meet it first
    live = low <= high
    region, at, low, high = region[live], at[live], low[live], high[live]
    place = room + (np.cumsum(size) - size)[region] + at
    data = np.concatenate([np.zeros(room, np.uint8), np.frombuffer(b"".join(regions), np.uint8), np.zeros(room, np.uint8)])
    up = _powers(_P, room + 1)
    ahead, behind = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(room):  # bytes past a region's end are taken off again before one of its windows is told
        behind += _BYTE[data[place + k + j]] * up[j]
    windows = size - length + 1
    start = (np.cumsum(windows) - windows)[region] + at
    mark = np.zeros(int(windows.sum()), bool)
    for l in range(room + 1):
        if l:
            ahead += _BYTE[data[place - l]] * up[l - 1]
            behind -= _BYTE[data[place + k + room - l]] * up[room - l]
        some = np.flatnonzero((l <= high) & (l >= low))
        if len(some) > 1:
            told = _mix(_mix(ahead[some]) + behind[some])
            order = np.argsort(told)
            same = np.flatnonzero(told[order[1:]] == told[order[:-1]])
            mark[start[some[order[same]]] - l] = mark[start[some[order[same + 1]]] - l] = True
    return np.split(mark, np.cumsum(windows)[:-1])


# On Spark.

RUNS = T.ArrayType(T.StructType([T.StructField("key", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("places", T.IntegerType()), T.StructField("at", T.IntegerType())]))
SPANS = "array<struct<first:int,after:int>>"
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))


def _spans(mark: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return [{"first": a, "after": b} for a, b in edge.reshape(-1, 2).tolist()]


def file_regions(owners: DataFrame, length: int, k: int) -> DataFrame:
    """owner and the regions of its data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Filer(length, k)
        for batch in batches:
            for i, j in pieces(batch.column(1), 8 << 20):
                rows = [cut(np.frombuffer(x or b"", np.uint8)) for x in batch.column(1).slice(i, j - i).to_pylist()]
                ends = np.append(0, np.cumsum([len(r[0]) for r in rows])).astype(np.int32)
                parts = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else []
                runs = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["key", "first", "after", "places", "at"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), runs)], ["owner", "runs"])

    return owners.select("owner", "data").mapInArrow(run, T.StructType([T.StructField("owner", T.BinaryType()), T.StructField("runs", RUNS)]))


def _take(found: DataFrame, length: int) -> DataFrame:
    """owner, data, regions -> a row a region with its id; its bytes stand where a batch meets it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column(1), 8 << 20):
                seen: set[bytes] = set()
                out: list[tuple] = []
                part = batch.slice(i, j - i)
                for owner, data, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for r in runs:
                        own = data[r["first"] : r["after"] + length - 1]
                        rid = hashlib.blake2b(own, digest_size=16).digest()
                        out.append((owner, r["first"], r["key"], rid, None if rid in seen else own, len(own), r["places"], r["at"]))
                        seen.add(rid)
                kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=["owner", "first", "key", "rid", "bytes", "size", "places", "at"])

    return found.select("owner", "data", "runs").mapInArrow(run, "owner binary, first int, key long, rid binary, bytes binary, size long, places int, at int")


def repeated_windows(owners: DataFrame, counts: DataFrame, length: int, level: int = 0) -> DataFrame:
    """owner and the spans of window starts that repeat.

    `owners` has owner and data, perhaps more than once each; `counts` has owner and n, once each.
    """
    k = max(1, min(length, round(length * PARTS[level])))
    runs = written(file_regions(owners, length, k).groupBy("owner").agg(F.first("runs").alias("runs")).join(counts, "owner"), "runs")
    each = runs.select("owner", "n", F.inline("runs"))
    keys = each.groupBy("key").agg(F.sum("n").alias("all"), F.max("places").alias("places")).where("all > 1 or places > 1").select("key")
    wanted = each.join(keys, "key").groupBy("owner").agg(F.collect_list(F.struct("key", "first", "after", "places", "at")).alias("runs"))
    data = owners.join(wanted, "owner").groupBy("owner").agg(F.first("data").alias("data"), F.first("runs").alias("runs"))
    taken = written(_take(data, length), "taken")
    regions = (taken.join(counts, "owner").groupBy("key", "rid")
               .agg(F.sum("n").alias("n"), F.first("bytes", ignorenulls=True).alias("bytes"), F.first("size").alias("size"), F.first("places").alias("places"), F.first("at").alias("at")))
    regions = written(regions, "regions")
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("size") - length + 1).cast("int").alias("after"))).cast(SPANS)
    known = regions.where("n > 1").select("rid", whole.alias("spans"))
    if level == len(PARTS) - 1:  # a key is one string: what isn't counted twice itself stands with others or in a run
        results = known.unionAll(regions.where("n = 1").select("rid", whole.alias("spans")))
    else:
        groups = regions.groupBy("key").agg(F.count("*").alias("members"), F.sum("size").alias("total"), F.sum("places").alias("places")).where("members > 1 or places > 1")
        groups = written(groups, "groups")
        small = groups.where(F.col("total") <= GROUP)
        total = small.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
        shards = max(1, -(-total // SHARD))
        packed = regions.join(small.select("key"), "key").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "rid", "n", "bytes")

        def told(table: pa.Table, marks: list[np.ndarray]) -> pa.Table:
            rows = [(r, _spans(m)) for r, n, m in zip(table.column("rid").to_pylist(), table.column("n").to_pylist(), marks, strict=True) if n == 1 and m.any()]
            return pa.table({"rid": pa.array([r for r, _ in rows], pa.binary()), "spans": pa.array([x for _, x in rows], _SPANS)})

        def sort(table: pa.Table) -> pa.Table:
            return told(table, repeats(table.column("bytes").to_pylist(), length))

        def count(table: pa.Table) -> pa.Table:
            return told(table, beside(table.column("bytes").to_pylist(), table.column("at").to_numpy().astype(np.int64), length, k))

        parts = min(shards, SPREAD * int(owners.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        results = known.unionAll(packed.repartition(parts, "shard").groupBy("shard").applyInArrow(sort, f"rid binary, spans {SPANS}"))
        fits = (F.col("total") <= HOT) & (F.col("places") <= PLACES)
        wide = F.broadcast(groups.where((F.col("total") > GROUP) & fits).select("key"))  # a key for GROUP bytes at most, 16 bytes a MB
        hot = F.broadcast(groups.where((F.col("total") > GROUP) & ~fits).select("key"))
        if wide.limit(1).count():
            results = results.unionAll(regions.join(wide, "key").select("key", "rid", "n", "bytes", "at").groupBy("key").applyInArrow(count, f"rid binary, spans {SPANS}"))
        if hot.limit(1).count():
            again = written(regions.join(hot, "key").select(F.col("rid").alias("owner"), F.col("bytes").alias("data"), "n"), "again")
            more = repeated_windows(again.select("owner", "data"), again.select("owner", "n"), length, level + 1)
            results = results.unionAll(more.join(again.where("n = 1").select("owner"), "owner").select(F.col("owner").alias("rid"), "spans"))
    moved = F.transform("spans", lambda x: F.struct((x["first"] + F.col("first")).alias("first"), (x["after"] + F.col("first")).alias("after")))
    out = taken.select("owner", "first", "rid").join(written(results, "repeats"), "rid").select("owner", F.explode(moved).alias("x"))
    return written(out.groupBy("owner").agg(F.collect_list("x").cast(SPANS).alias("spans")), "windows")


def word_codes(texts: list[bytes], cut: Filer) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, and the number of the text it is in."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.flatnonzero(np.diff(_BLANK[data], prepend=True))
    start, end = edge[::2], edge[1::2]
    codes = np.zeros(len(start), np.uint64)
    cut.grow(SEGMENT)
    for s in range(0, len(data), SEGMENT):
        part = data[s : s + SEGMENT]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * cut.up[: len(part)], out=sums[1:])
        i, j = np.searchsorted(end, s, "right"), np.searchsorted(start, s + len(part))
        a, b = np.maximum(start[i:j] - s, 0), np.minimum(end[i:j] - s, len(part))
        told = (sums[b] - sums[a]) * cut.down[a]
        if i < j and start[i] < s:
            told[:1] *= np.uint64(pow(_P, s - int(start[i]), 1 << 64))
        codes[i:j] += told
    return _mix(codes), np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, "right")


def passages(texts: list[bytes], cut: Filer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each string of words as long as `cut` has them: the number of its text, its key and its hash."""
    codes, text = word_codes(texts, cut)
    windows, more = len(codes) - cut.length + 1, cut.length - 1
    if windows < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, first, after, _, _ = cut(codes)
    told = np.concatenate([cut.hashes(codes[s : s + SEGMENT + more], cut.length) for s in range(0, windows, SEGMENT)])
    inside = text[:windows] == text[more:]
    return text[:windows][inside], np.repeat(key, after - first)[inside], told[inside].view(np.int64)


def _lists(text: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """The different values of each of n texts."""
    order = np.lexsort((values, text))
    text, values = text[order], values[order]
    new = np.append(True, (text[1:] != text[:-1]) | (values[1:] != values[:-1]))[: len(text)]
    ends = np.append(0, np.cumsum(np.bincount(text[new], minlength=n)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[new]))


def shared_passages(owners: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """owner and n_shared, its different strings of `words` words that stand in another document too, if any; arguments as for `repeated_windows`."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Filer(words, min(ANCHOR, words))
        for batch in batches:
            for i, j in pieces(batch.column(1), 8 << 20):
                text, key, told = passages(batch.column(1).slice(i, j - i).to_pylist(), cut)
                run = np.append(True, (text[1:] != text[:-1]) | (key[1:] != key[:-1]))[: len(text)]
                own = told + text  # equal strings of a text alike, of others apart
                order = np.argsort(own)
                new = np.append(True, own[order[1:]] != own[order[:-1]])[: len(own)]
                strings = pa.array(np.bincount(text[order[new]], minlength=j - i))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(text[run], key[run], j - i), strings], ["owner", "keys", "strings"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Filer(words, min(ANCHOR, words))
        for batch in batches:
            for i, j in pieces(batch.column(1), 8 << 20):
                text, key, told = passages(batch.column(1).slice(i, j - i).to_pylist(), cut)
                wanted = np.isin(key, batch.column(2).slice(i, j - i).flatten().to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(text[wanted], told[wanted], j - i)], ["owner", "keys"])

    def twice(listed: DataFrame) -> DataFrame:
        each = listed.select("owner", F.explode("keys").alias("key"))
        return each.join(each.groupBy("key").count().where("count > 1").select("key"), "key")

    filed = owners.select("owner", "data").mapInArrow(file, "owner binary, keys array<long>, strings long").where("strings > 0")
    filed = written(filed.groupBy("owner").agg(F.first("keys").alias("keys"), F.first("strings").alias("strings")).join(counts, "owner"), "filed")
    wanted = twice(filed).groupBy("owner").agg(F.collect_list("key").alias("keys"))
    data = owners.join(wanted, "owner").groupBy("owner").agg(F.first("data").alias("data"), F.first("keys").alias("keys"))
    told = written(data.mapInArrow(tell, "owner binary, keys array<long>"), "told")
    shared = twice(told).groupBy("owner").agg(F.count("*").alias("n_shared")).unionAll(filed.where("n > 1").select("owner", "strings"))
    return written(shared.groupBy("owner").agg(F.max("n_shared").alias("n_shared")), "shared")  # of equal texts all strings are shared


def removed(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte ranges that windows starting in these spans cover, joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["after"] + length - 1) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept, the bytes that stay, and n_shared, its different strings of `words` words that another document has too, of every row."""
    base = prepared(docs, text, key).select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data")).withColumn("owner", F.unhex(F.md5("data")))
    counts = written(base.groupBy("owner").agg(F.count("*").alias("n")), "counts")
    long = base.where(F.octet_length("data") >= length).select("owner", "data")
    spans = repeated_windows(long, counts, length)
    all_of = F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).alias("after"))).cast(SPANS)  # equal texts go whole
    shared = shared_passages(base.where(F.octet_length("data") >= 2 * words - 1).select("owner", "data"), counts, words)
    told = counts.join(spans, "owner", "left").join(shared, "owner", "left").select("owner", F.when(F.col("n") > 1, all_of).otherwise(F.col("spans")).alias("spans"), "n_shared")
    rows = base.join(told.where("spans is not null or n_shared > 0"), "owner", "left").select("doc_id", "data", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column(1), 8 << 20):
                part, out = batch.slice(i, j - i), []
                for data, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if not found:
                        out.append((len(data), 0, 0, data))
                    elif found[0]["after"] < 0:
                        gone = len(data) >= length
                        out.append((len(data), len(data) * gone, int(gone), b"" if gone else data))
                    else:
                        cuts = removed(found, length)
                        kept = b"".join(data[a:b] for a, b in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(data)], strict=True))
                        out.append((len(data), len(data) - len(kept), len(cuts), kept))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                cols = [part.column(0), *(pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)), part.column(3)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_shared long")
