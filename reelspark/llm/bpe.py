"""BPE encoding and decoding by a pair occurrence index.

Every distinct word of a batch is laid out in one flat symbol list. The index maps each mergeable pair to
all its positions; the active ranks are taken in ascending order from a heap, a rank is applied at all its
positions at once, and only the lists of the pairs beside them are updated.

Null text counts as empty; an empty text has no ids and decodes to the empty text. Special tokens that
stand in a text become their ids, as in the public library.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reelspark.llm.common import map_rows

# Fixed values of the public format: what counts as white space, and the pattern of the words.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^" + SPACE + "\\p{L}\\p{N}]+"
# Chunks whose encoding a task remembers (beyond it the memory starts anew), and the longest of them.
MEMORY, REMEMBERED = 300_000, 64
_NONE = 1 << 40


def load(path: str) -> dict:
    """The tables of a tokenizer file: symbols of bytes, pairs in order of rank, token strings, special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model["type"] != "BPE" or model["end_of_word_suffix"] is None or spec["decoder"] is not None:
        raise ValueError("a BPE file with word ends and no decoder is expected")
    vocab, end = model["vocab"], model["end_of_word_suffix"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
    for t, i in vocab.items():
        tokens[i] = t
    for t in spec["added_tokens"]:
        tokens[t["id"]] = t["content"]
    a = np.array([vocab[x] for x, _ in model["merges"]], np.int64)
    b = np.array([vocab[y] for _, y in model["merges"]], np.int64)
    return {
        "first": np.array([vocab[char[x]] for x in range(256)], np.int32), "last": np.array([vocab[char[x] + end] for x in range(256)], np.int32),
        "a": a, "b": b, "new": np.array([vocab[x + y] for x, y in model["merges"]], np.int32), "tokens": tokens,
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


class PairIndex:
    """Encodes lists of words with the tables of `load`."""

    def __init__(self, tables: dict):
        self.t = tables
        keys = tables["a"] << 20 | tables["b"]
        self.order = np.argsort(keys)
        self.keys = np.append(keys[self.order], 1 << 62)
        self.order = np.append(self.order, _NONE)
        n, size = len(tables["a"]), len(tables["tokens"])
        least = np.full(size, _NONE)
        np.minimum.at(least, tables["a"], np.arange(n))
        np.minimum.at(least, tables["b"], np.arange(n))
        # Ranks whose new token takes part in an earlier rank: these are applied to one position a word at a time.
        self.early = least[tables["new"]] < np.arange(n)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each word has. Words aren't empty."""
        t = self.t
        data = np.frombuffer(b"".join(words), np.uint8)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        n, ends = len(data), np.cumsum(lens)
        sym = np.append(t["first"][data], np.int32(-1))  # the place n stands for "no symbol"
        sym[ends - 1] = t["last"][data[ends - 1]]
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[ends - 1] = n
        prv[ends - lens] = n
        word = np.repeat(np.arange(len(words), dtype=np.int32), lens)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(pos: np.ndarray) -> None:
            rank = self.ranks(sym[pos], sym[nxt[pos]])
            fits = rank < _NONE
            if not fits.any():
                return
            pos, rank = pos[fits], rank[fits]
            if len(pos) > 1:
                by = np.argsort(rank, kind="stable")
                pos, rank = pos[by], rank[by]
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                lists, firsts = np.split(pos, cuts) if len(cuts) else [pos], rank[np.append(0, cuts)].tolist()
            else:
                lists, firsts = [pos], [int(rank[0])]
            for r, p in zip(firsts, lists, strict=True):
                if (at := index.get(r)) is None:
                    index[r] = [p]
                    heapq.heappush(heap, r)
                else:
                    at.append(p)

        add(np.flatnonzero(nxt[:n] != n).astype(np.int32))
        while heap:
            r = heapq.heappop(heap)
            a, b, new = int(t["a"][r]), int(t["b"][r]), t["new"][r]
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            pos = pos[(sym[pos] == a) & (sym[nxt[pos]] == b)]
            if not len(pos):
                continue
            if a == b and len(pos) > 1:  # of overlapping places every second one of a run, from its left
                joined = np.append(False, nxt[pos[:-1]] == pos[1:])
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(pos))))
                pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
            if self.early[r] and len(pos) > 1:
                leading = np.append(True, word[pos[1:]] != word[pos[:-1]])
                if not leading.all():
                    index[r] = [pos[~leading]]
                    heapq.heappush(heap, r)
                    pos = pos[leading]
            gone = nxt[pos]
            after = nxt[gone]
            sym[pos], sym[gone] = new, -2
            nxt[pos], prv[after] = after, pos
            before = prv[pos]
            beside = np.concatenate([before[before != n], pos[after != n]])
            if len(beside):
                if len(beside) > 1:
                    beside.sort()
                    beside = beside[np.append(True, beside[1:] != beside[:-1])]
                add(beside)
        alive = sym[:n] >= 0
        return sym[:n][alive], np.bincount(word[alive], minlength=len(words))


class Encoder:
    """Whole texts to ids, with a bounded memory of the chunks between white space."""

    def __init__(self, tables: dict):
        self.index, self.tokens, self.special = PairIndex(tables), tables["tokens"], tables["special"]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(WORDS)
        self.space = regex.compile(f"[{SPACE}]+")
        self.odd = regex.compile("[\\x1c-\\x1f]")  # white space for Python alone
        self.memory: dict[str, bytes] = {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}

    def chunks(self, text: str) -> list[str]:
        if self.split is None or not any(s in text for s in self.special):
            return self.space.split(text) if self.odd.search(text) else text.split()
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.chunks(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.chunks(text[at:])

    def pieces(self, chunk: str) -> list[bytes]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            # letter by letter: a final sigma isn't told apart
            chunk = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()
        else:
            chunk = chunk.lower()
        return [w.encode("utf-8", "surrogatepass") for w in self.words.findall(chunk)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memory) > MEMORY:
            self.memory = {s: self.memory[s] for s in self.special}
        memory = self.memory
        split = [self.chunks(t) for t in texts]
        fresh = list({c for chunks in split for c in chunks if c not in memory})
        if fresh:
            cut = [self.pieces(c) for c in fresh]
            place = {w: k for k, w in enumerate(dict.fromkeys(w for ws in cut for w in ws))}
            if place:
                ids, counts = self.index.encode(list(place))
                raw, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
                coded = [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
            for c, ws in zip(fresh, cut, strict=True):
                memory[c] = coded[place[ws[0]]] if len(ws) == 1 else b"".join(coded[place[w]] for w in ws)
        out = [b"".join(map(memory.__getitem__, chunks)) for chunks in split]
        for c in fresh:
            if len(c) > REMEMBERED and c not in self.special:
                del memory[c]
        return out


def decode_ids(ids: bytes, tokens: list[str]) -> str:
    """Tokens beside each other, a space between them: the file has no decoder, so word ends stay visible."""
    return " ".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the ids of each text as a binary column of little-endian unsigned 32-bit integers.

    `tokenizer` is the path of the vocabulary file on the driver; its tables (a fixed size) are broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer))

    def make():
        encoder = Encoder(shared.value)
        return lambda texts: {to: encoder(texts)}

    return map_rows(docs, text, [T.StructField(to, T.BinaryType())], make, most=2 << 20)


def decode(docs: DataFrame, tokenizer: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of each id list; null ids give the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer)["tokens"])

    def make():
        tokens = shared.value
        return lambda lists: {to: [decode_ids(x or b"", tokens) for x in lists]}

    return map_rows(docs, ids, [T.StructField(to, T.StringType())], make, most=2 << 20)
