"""Language identification of mixed-language text.

The script of a word's letters narrows the languages that may have written it, character n-grams score it for
each of those, and a Viterbi pass over the words of a text, with a penalty for every switch of language, labels
spans. The language with most letters is the text's.

All counts cover every training row: each task sums its n-grams in an array of fixed size, Spark adds these up.
Null texts and texts without letters are `und` with score 0, as is everything where nothing could be learned.
Ties go to the language that sorts first. Rows without a language are not learned from. A letter is what Unicode
calls one; marks belong to the word they stand in. Words of more than LONG characters, as in text without blanks,
are taken in parts of that length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from reelspark.llm.common import map_rows, pieces, texts_of

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
SWITCH = 14.0
#: A word of a script that a language hardly uses costs so much.
FOREIGN = 40.0
LEAST_SHARE = 1e-3
MOST_WORD = 24.0
#: Words that a task remembers, and the longest of them.
MEMORY, REMEMBERED = 250_000, 64
LONG = 512
#: Characters whose n-grams are in memory at a time.
SLICE = 1 << 18
# First code point of each block of scripts, and the script from there on.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"),
           (0x0E00, "thai"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
           (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"))
STARTS = np.array([s for s, _ in SCRIPTS])
KINDS = sorted({k for _, k in SCRIPTS})
KIND_AT = np.array([KINDS.index(k) for _, k in SCRIPTS])
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_SPACE = regex.compile(r"\s")


def split(text: str) -> Iterator[list[str]]:
    """The chunks between white space, some thousand at a time, none longer than LONG."""
    at = 0
    while at < len(text):
        end = at + (1 << 16)
        if end < len(text) and (m := _SPACE.search(text, end)):
            end = m.start()
        elif end < len(text):
            end = len(text)
        if max(map(len, out := text[at:end].split()), default=0) > LONG:
            out = [c[i : i + LONG] for c in out for i in range(0, len(c), LONG)]
        yield out
        at = end


def letters(chunk: str) -> str:
    """The letter runs of a chunk in lower case, each between marks."""
    return "".join(f"\x02{w}\x03" for w in _LETTERS.findall(chunk.lower()))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram; n-grams don't cross from one word to the next."""
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    buckets, owners = [], []
    for n in GRAMS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        inside = owner[: len(h)] == owner[n - 1 :]
        for i in range(n):
            c = code[i : i + len(h)]
            h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if i:  # a start mark stands at the first place only, an end mark at the last
                inside &= c != 2
            if i < n - 1:
                inside &= c != 3
        buckets.append((h[inside] >> np.uint64(17)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(h)][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets), np.concatenate(owners)


def sliced(words: list[str]) -> Iterator[range]:
    """Ranges of words with at most about SLICE characters."""
    start = size = 0
    for i, w in enumerate(words):
        if size > SLICE:
            yield range(start, i)
            start, size = i, 0
        size += len(w)
    if start < len(words):
        yield range(start, len(words))


def scripts(words: list[str]) -> np.ndarray:
    """Script number of each word by its last letter; words aren't empty."""
    last = np.array([ord(w[-2]) for w in words], np.int64)  # a mark has the script of its block
    return KIND_AT[np.searchsorted(STARTS, last, "right") - 1]


def count(rows: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, kind ('gram' or 'script'), slot, n over all rows with a text and a language."""
    rows = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, j in pieces(batch.column(0), 1 << 20):
                chunks: dict[str, Counter] = {}

                def add(lang: str) -> None:
                    seen = chunks.pop(lang)
                    words = [(w, n) for c, n in seen.items() if (w := letters(c))]
                    total = sums.setdefault(lang, np.zeros(BUCKETS + len(KINDS)))
                    for part in sliced([w for w, _ in words]):
                        own, times = [words[k][0] for k in part], np.array([words[k][1] for k in part], float)
                        bucket, owner = grams(own)
                        total[:BUCKETS] += np.bincount(bucket, times[owner], BUCKETS)
                        total[BUCKETS:] += np.bincount(scripts(own), times, len(KINDS))

                for text, lang in zip(texts_of(batch.column(0).slice(i, j - i)), batch.column(1).slice(i, j - i).to_pylist(), strict=True):
                    for some in split(text):
                        chunks.setdefault(lang, Counter()).update(some)
                        if len(chunks[lang]) > MEMORY:
                            add(lang)
                for lang in list(chunks):
                    add(lang)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], names=["lang", "slot", "n"])

    return rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """Languages, log-probabilities (buckets x languages) and the scripts each language uses.

    The table that comes to the driver has at most BUCKETS + len(KINDS) rows a language, at any corpus size.
    """
    got = count(rows, text, lang).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    total = np.zeros((len(langs), BUCKETS + len(KINDS)))
    for k, name in enumerate(langs):
        own = got[got["lang"] == name]
        total[k, own["slot"].to_numpy()] = own["n"].to_numpy()
    n, script = total[:, :BUCKETS], total[:, BUCKETS:]
    share = script / np.maximum(1, script.sum(1, keepdims=True))
    log = np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return {"langs": langs, "log": np.ascontiguousarray(log.T, np.float32), "uses": share.T >= LEAST_SHARE}


class Labeller:
    """Scores words, then labels the words of each text."""

    def __init__(self, model: dict):
        self.m, self.n = model, len(model["langs"])
        self.start()

    def start(self) -> None:
        self.memory: dict[str, int] = {}
        self.scores = np.zeros((0, self.n), np.float32)
        self.sizes = np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        words = [letters(c) for c in chunks]
        full = [i for i, w in enumerate(words) if w]
        scores = np.zeros((len(words), self.n), np.float32)
        if self.n:
            for part in sliced([words[i] for i in full]):
                at = full[part.start : part.stop]
                kept = [words[i] for i in at]
                bucket, owner = grams(kept)
                own = np.stack([np.bincount(owner, self.m["log"][bucket, k], len(kept)) for k in range(self.n)], 1)
                own -= own.max(1, keepdims=True)
                own = np.maximum(own, -MOST_WORD)
                uses = self.m["uses"][scripts(kept)]
                own -= np.where(uses | ~uses.any(1, keepdims=True), 0, FOREIGN)
                scores[at] = own
        first = len(self.sizes)
        self.memory.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        self.scores = np.concatenate([self.scores, scores])
        self.sizes = np.append(self.sizes, [len(w) - 2 * w.count("\x02") for w in words])

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """Places of each text's chunks among the scores; words new to the memory are scored together."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def place() -> None:
            if fresh := list({c for _, chunks in held for c in chunks if c not in self.memory}):
                self.learn(fresh)
            for i, chunks in held:
                out[i].append(np.fromiter(map(self.memory.__getitem__, chunks), np.int32, len(chunks)))
            for c in fresh:  # long ones keep their scores until the texts at hand are labelled, but are not looked up again
                if len(c) > REMEMBERED:
                    del self.memory[c]
            held.clear()

        for i, text in enumerate(texts):
            for chunks in split(text):
                held.append((i, chunks))
                size += len(chunks) + 1
                if size > MEMORY:
                    place()
                    size = 0
        place()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def paths(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels of each text's words, all texts of a batch abreast, longest first."""
        by = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        lens = np.array([len(rows[i]) for i in by])
        steps = int(lens[0]) if len(lens) else 0
        active = np.searchsorted(-lens, -np.arange(steps), "left")  # texts with more than t words
        starts = np.append(0, np.cumsum(lens))[:-1]
        flat = np.concatenate([rows[i] for i in by]) if by else np.zeros(0, np.int64)
        best = np.zeros((len(by), self.n), np.float32)
        tops, stays = np.zeros(len(flat), np.int16), np.zeros((len(flat), (self.n + 7) // 8), np.uint8)  # where each path came from
        for t in range(steps):
            k = active[t]
            v = best[:k]
            top = v.argmax(1)
            jump = v[np.arange(k), top][:, None] - SWITCH
            stay = v >= jump
            at = starts[:k] + t
            tops[at], stays[at] = top, np.packbits(stay, axis=1)
            v = np.where(stay, v, jump) + self.scores[flat[at]]
            best[:k] = v - v.max(1, keepdims=True)
        labels = np.zeros(len(flat), np.int16)
        state = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            at = starts[:k] + t
            labels[at] = state[:k]
            stayed = stays[at, state[:k] >> 3] >> (7 - (state[:k] & 7)) & 1
            state[:k] = np.where(stayed, state[:k], tops[at])
        out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(rows)
        for i, s, n in zip(by, starts.tolist(), lens.tolist(), strict=True):
            out[i] = labels[s : s + n]
        return out

    def __call__(self, texts: list[str]) -> dict[str, list]:
        if len(self.sizes) > MEMORY:
            self.start()
        rows = self.rows(texts)
        out: dict[str, list] = {"lang_pred": [], "score": [], "spans": []}
        for row, label in zip(rows, self.paths(rows) if self.n else rows, strict=True):
            size = self.sizes[row]
            if not self.n or not size.any():
                pred, score, spans = "und", 0.0, ""
            else:
                share = np.bincount(label, size, self.n) / size.sum()
                at = int(share.argmax())
                cuts = np.append(0, np.flatnonzero(np.diff(label)) + 1).tolist()
                spans = ",".join(f"{self.m['langs'][label[i]]}:{i}:{j}" for i, j in zip(cuts, [*cuts[1:], len(label)], strict=True))
                pred, score = self.m["langs"][at], float(share[at])
            out["lang_pred"].append(pred)
            out["score"].append(score)
            out["spans"].append(spans)
        return out


def label(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (its share of the letters) and spans (`lang:first word:word after` in order)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.StringType())]
    return map_rows(docs, text, fields, lambda: Labeller(shared.value), most=8 << 20)


def remainder(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % of
