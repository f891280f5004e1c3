"""Token ids in files of blocks, coded by a range coder that mixes the predictions of three contexts.

A block holds up to BLOCK ids of whole documents (a longer document has blocks of its own) and is coded by itself:
its models start empty, and it carries checksums of its bytes and of its ids.

Coding. A block's ids are laid out in lanes, each a run of consecutive ids; all lanes take a step at a time, in numpy.
For the next id of a lane, the two ids before it (order 2) and the one before it (order 1) each predict the id that
last stood there, with a confidence of 0 to 3, and counts of all ids so far (order 0) predict every id. How much of the
range each prediction gets is learned for every pair of confidences from how often it has been right. An arithmetic
coder for each lane takes the id's share of the mixed range; carries are resolved at the end of the block.

Files. Documents are sorted by id over all files (range partitions, nulls first, ties by the text's hash); a file is
one partition. Spark's writers have no plain binary files, so a file is rows of a table in the shared folder: file,
block, part and more (blocks of one long document), first (ids in the file before it), n and payload, the whole block
with its directory of documents.

Null text counts as empty and has the end id alone. Rows that repeat are documents of their own. Other columns are
not written. A text may be of any length; it is tokenized whole, and its ids are held at once.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from reelspark.llm.common import pieces, prepared, release

BLOCK = 1 << 20
LANES, STEPS = 4096, 256
#: Bits of the mixing weights, of the hash of two ids, and steps between two readings of the id counts.
WEIGHT, CONTEXT, EVERY = 10, 18, 32
#: Strings that a worker remembers the ids of, words of even texts among them, and the longest.
MEMORY, WORDS, LONGEST = 800_000, 400_000, 48
MAGIC = b"IDS1"
HEAD = struct.Struct("<4sIIIII")
#: The pre-tokenizer of byte-level vocabularies of this family (fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters that Python takes for spaces, which are more than the library's, and where a unit of text may begin.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BETWEEN = re.compile(r"(?<=\S) ")
#: Texts that are not cut at every space, and texts that are not cut at every line.
_ODD, _LINES = f"{_SPACE} | \n", f"{_SPACE}\n"
#: A word and signs behind it, the two pieces of most strings: letters that every version of Unicode has, no apostrophe.
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_WORD = r"^\n?[A-Za-zÀ-ÖØ-öø-ɏ]+$"
#: Byte-level vocabularies write printable bytes as they are and the others, in order, as the characters from 256 on;
#: 255 stands in no text and becomes a blank.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_VISIBLE = np.arange(256, dtype="<u4")
_VISIBLE[[b for b in range(256) if b not in _PLAIN]] = 256 + np.arange(256 - len(_PLAIN))
_VISIBLE[255] = 32
_32 = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


class Model:
    """Predictions for the next id of every lane, learned from all ids of the block so far."""

    def __init__(self, size: int, lanes: int):
        self.size, self.bits = size, max(18, size.bit_length() + 1)
        self.shift, self.whole = np.uint64(self.bits), np.uint64(1 << WEIGHT)
        self.count = np.zeros(size, np.int64)
        self.by_one, self.by_two = np.zeros(size, np.int32), np.zeros(1 << CONTEXT, np.int32)  # id << 2 | confidence
        self.right = np.tile(np.array([1, 1, 4], np.int64), 32)
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.recent: list[np.ndarray] = []
        self.read()

    def read(self) -> None:
        """Turns counts into shares of 1 << bits, one at least for each id."""
        if self.recent:
            self.count += np.bincount(np.concatenate(self.recent), minlength=self.size)
            self.recent = []
        total = max(1, int(self.count.sum()))
        share = 1 + self.count * ((1 << self.bits) - self.size) // total
        share[share.argmax()] += (1 << self.bits) - share.sum()
        self.share = share
        self.place = ((np.cumsum(share) - share) << 32 | share).astype(np.uint64)  # start and width beside each other
        self.slots: np.ndarray | None = None

    def predict(self, k: int) -> None:
        """For the first k lanes: the ids of both contexts, and how much of the range they get."""
        self.last = self.one[:k]
        self.at = ((self.two[:k].astype(np.uint32) * _A ^ self.last.astype(np.uint32) * _B) >> np.uint32(32 - CONTEXT)).astype(np.int64)
        first, second = self.by_one.take(self.last), self.by_two.take(self.at)
        self.c1, self.f1, self.c2, self.f2 = first >> 2, first & 3, second >> 2, second & 3
        mix = self.f2 << 3
        mix |= self.f1 << 1
        mix |= self.c1 == self.c2
        self.mix = mix.astype(np.int64)
        n = self.right.reshape(32, 3)
        w = (1 + n[:, :2] * ((1 << WEIGHT) - 3) // n.sum(1)[:, None]).astype(np.uint64)
        both = w.sum(1)
        self.rest = (self.whole - both).take(self.mix)
        self.to2, self.to1 = (w[:, 0] << self.shift).take(self.mix), (both << self.shift).take(self.mix)  # ends of both predictions

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id's share of 1 << (bits + WEIGHT)."""
        self.hit2, self.hit1 = ids == self.c2, ids == self.c1
        place = self.place.take(ids)
        start = (place >> _32) * self.rest
        start += self.to1
        width = (place & _LOW) * self.rest
        lone = self.hit1 > self.hit2
        self.outcome = np.int8(2) - self.hit2 * np.int8(2) - lone
        start = np.where(self.hit2, np.uint64(0), np.where(lone, self.to2, start))
        return start, np.where(self.hit2, self.to2, np.where(lone, self.to1 - self.to2, width))

    def found(self, at: np.ndarray) -> np.ndarray:
        """The ids whose shares hold these points of the range."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.size, dtype=np.int32), self.share)
        rest = np.maximum(at, self.to1)
        rest -= self.to1
        rest //= self.rest
        return np.where(at < self.to2, self.c2, np.where(at < self.to1, self.c1, self.slots.take(rest.view(np.int64))))

    def learn(self, ids: np.ndarray, step: int) -> None:
        k = len(ids)
        self.right += np.bincount(self.mix * 3 + self.outcome, minlength=96)
        for table, at, old, conf, hit in ((self.by_one, self.last, self.c1, self.f1, self.hit1), (self.by_two, self.at, self.c2, self.f2, self.hit2)):
            new = np.where(hit | (conf > 1), old, ids) << np.int32(2)  # a prediction that is wrong at 0 or 1 gives way
            conf += hit
            conf += hit
            conf -= np.int32(1)
            new |= np.minimum(np.maximum(conf, np.int32(1)), np.int32(3))
            table[at] = new
        self.two[:k] = self.one[:k]
        self.one[:k] = ids
        self.recent.append(ids)
        step += 1
        if step % EVERY == 0 or step < EVERY and step & (step - 1) == 0:
            self.read()


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // STEPS))
    steps = -(-n // lanes) if n else 0
    return (-(-n // steps) if n else 0), steps


def squeezed(ids: np.ndarray, size: int) -> bytes:
    """The range coder's words of all lanes, after how many each has."""
    n = len(ids)
    lanes, steps = _shape(n)
    if not n:
        return b""
    rows = np.zeros(lanes * steps, np.int32)
    rows[:n] = ids
    rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    model = Model(size, lanes)
    total = np.uint64(model.bits + WEIGHT)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max)
    words, put = np.zeros((steps + 2) * lanes, np.uint64), np.arange(lanes)  # word by word, all lanes beside each other
    last = n - (lanes - 1) * steps
    for t in range(steps):
        k = lanes if t < last else lanes - 1
        own = rows[t, :k]
        model.predict(k)
        start, share = model.spans(own)
        part = width[:k] >> total
        new = low[:k] + start * part
        carry = np.flatnonzero(new < low[:k])
        if len(carry):
            words[put[carry] - lanes] += np.uint64(1)
        part *= share
        full = np.flatnonzero(part <= _LOW)
        if len(full):
            words[put[full]] = new[full] >> _32
            put[full] += lanes
            new[full] <<= _32
            part[full] <<= _32
        low[:k], width[:k] = new, part
        model.learn(own, t)
    end = low + _LOW  # a number in the last range whose lower half is 0
    carry = np.flatnonzero(end < low)
    words[put[carry] - lanes] += np.uint64(1)
    words[put] = end >> _32
    many = put // lanes + 1
    words = words.reshape(-1, lanes)
    for i in range(int(many.max()) - 1, 0, -1):
        words[i - 1] += words[i] >> _32
    told = (words & _LOW).astype("<u4").T[np.arange(len(words)) < many[:, None]]
    return many.astype("<u4").tobytes() + told.tobytes()


def expanded(data: bytes, n: int, size: int) -> np.ndarray:
    lanes, steps = _shape(n)
    if not n:
        return np.zeros(0, np.int32)
    many = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(data, "<u4", offset=4 * lanes), np.zeros(2, np.uint32)).astype(np.uint64)
    end = np.cumsum(many)
    at = end - many

    def word(lane: np.ndarray) -> np.ndarray:
        """The lane's next word, 0 after its last."""
        out = np.where(at[lane] < end[lane], words[np.minimum(at[lane], len(words) - 1)], np.uint64(0))
        at[lane] += 1
        return out

    every = np.arange(lanes)
    value = word(every) << _32
    value |= word(every)
    model = Model(size, lanes)
    total = np.uint64(model.bits + WEIGHT)
    top = np.uint64((1 << (model.bits + WEIGHT)) - 1)
    width = np.full(lanes, np.iinfo(np.uint64).max)
    rows = np.zeros((steps, lanes), np.int32)
    last = n - (lanes - 1) * steps
    for t in range(steps):
        k = lanes if t < last else lanes - 1
        model.predict(k)
        part = width[:k] >> total
        own = model.found(np.minimum(value[:k] // part, top))
        start, share = model.spans(own)
        left = value[:k] - start * part
        part *= share
        full = np.flatnonzero(part <= _LOW)
        if len(full):
            left[full] = left[full] << _32 | word(full)
            part[full] <<= _32
        value[:k], width[:k] = left, part
        rows[t, :k] = own
        model.learn(own, t)
    return rows.T.reshape(-1)[:n]


# Blocks.


def block(ids: np.ndarray, docs: list[int | None], lens: list[int], part: int = 0, more: bool = False) -> bytes:
    """Bytes of a block; `part` counts the blocks of a document that has several, `more` says that one follows."""
    raw = ids.astype("<u4").tobytes()
    size = int(ids.max()) + 1 if len(ids) else 1
    ids_of = np.array([0 if d is None else d for d in docs], "<i8")
    table = zlib.compress(ids_of.tobytes() + np.array(lens, "<u4").tobytes() + bytes(d is None for d in docs), 6)
    body = struct.pack("<IIII", part, more, len(docs), len(table)) + table + squeezed(ids, size)
    return HEAD.pack(MAGIC, len(ids), size, zlib.crc32(raw), zlib.crc32(body), len(body)) + body


def unblock(data: bytes) -> tuple[np.ndarray, list[int | None], list[int], int, bool]:
    """ids, documents, their lengths, part and more of a block; an error where a checksum does not hold."""
    magic, n, size, crc, own, length = HEAD.unpack_from(data)
    body = memoryview(data)[HEAD.size :]
    if magic != MAGIC or length != len(body) or zlib.crc32(body) != own:
        raise ValueError("damaged block of ids")
    part, more, docs, table = struct.unpack_from("<IIII", body)
    head = zlib.decompress(body[16 : 16 + table])
    keys, lens, none = np.frombuffer(head, "<i8", docs), np.frombuffer(head, "<u4", docs, 8 * docs), head[12 * docs :]
    ids = expanded(bytes(body[16 + table :]), n, size)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("damaged ids")
    return ids, [None if x else k for k, x in zip(keys.tolist(), none, strict=True)], lens.tolist(), part, bool(more)


def gathered(flat: np.ndarray, begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of `flat` that begin there, one behind the other, and where each one's end."""
    ends = np.append(0, np.cumsum(lens))
    return flat.take(np.repeat(begin - ends[:-1], lens) + np.arange(ends[-1])), ends


class Ids:
    """Remembered ids of strings: each has a place, its ids stand in a row with those of all others."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def put(self, fresh: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n = len(self.first) - 1
        self.place.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        self.add(ids, lens)

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, ids])
        self.first = np.append(self.first, self.first[-1] + np.cumsum(lens))

    def at(self, strings: list[str]) -> np.ndarray:
        """Places of strings, -1 for those not known."""
        return np.fromiter(map(self.place.get, strings, repeat(-1)), np.int64, len(strings))

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the strings at these places, and where each one's end."""
        begin = self.first.take(at)
        return gathered(self.flat, begin, self.first.take(at + 1) - begin)

    def forget(self, fresh: list[str]) -> None:
        """Forgets the long ones of the strings put last, and all where there are too many."""
        if len(self.place) > MEMORY:
            self.__init__()
        elif any(len(f) > LONGEST for f in fresh):
            kept = [f for f in fresh if len(f) <= LONGEST]
            ids, ends = self.get(self.at(kept))
            n = len(self.first) - 1 - len(fresh)
            for f in fresh:
                del self.place[f]
            self.first, self.flat = self.first[: n + 1], self.flat[: self.first[n]]
            self.put(kept, ids, np.diff(ends))


class Words(Ids):
    """The same for Arrow's strings, none of them twice; those in no recent piece of text are forgotten."""

    def __init__(self):
        super().__init__()
        self.strings, self.used, self.now = pa.array([], pa.large_string()), np.zeros(0, np.int64), 0

    def put(self, fresh: pa.Array, ids: np.ndarray, lens: np.ndarray) -> None:
        self.strings, self.used = pa.concat_arrays([self.strings, fresh]), np.append(self.used, np.zeros(len(fresh), np.int64))
        self.add(ids, lens)

    def at(self, strings: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(strings, value_set=self.strings), -1).to_numpy().astype(np.int64)

    def forget(self, at: np.ndarray) -> None:
        """Forgets long strings, and where there are too many also those neither at these places nor at the ones before."""
        self.now += 1
        self.used[at] = self.now
        kept = pc.less_equal(pc.utf8_length(self.strings), LONGEST).to_numpy(zero_copy_only=False)
        if len(kept) > WORDS:
            kept = kept & (self.used >= self.now - 1)
        if not kept.all():
            self.used, places = self.used[kept], np.flatnonzero(kept)
            (self.flat, self.first), self.strings = self.get(places), self.strings.take(pa.array(places))


class Encoder:
    """ids of texts as the library gives them.

    Texts are cut before single spaces and lines after a character that is no space, where no piece of the
    pre-tokenizer can cross. Arrow tells the different strings between and looks them up. Of new ones words and the signs
    behind them go through the library's model, many at a time; other strings are cut into pieces first, and pieces not
    seen yet go there. A piece by itself is cut into itself, so one memory serves both.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = {s.content: i for i, s in self.library.get_added_tokens_decoder().items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.library.pre_tokenizer, self.library.post_processor = WhitespaceSplit(), None  # pieces come between blanks
        self.units = self.pieces = Ids()
        self.words = Words()  # strings as they stand behind a space, or with the end of a line before them

    def model(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all pieces, and how many each has."""
        cuts = np.append(np.arange(0, len(pieces), 500), len(pieces)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), pieces.cast(pa.large_binary()).cast(pa.binary())), b"\xff")
        found = self.library.encode_batch([_VISIBLE[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in lines.to_pylist()], add_special_tokens=False)
        ids = [np.array(e.ids, np.uint32) for e in found]
        lens = [np.bincount(np.array(e.word_ids, np.int64)) for e in found]
        return (np.concatenate(ids), np.concatenate(lens)) if len(pieces) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def learn(self, units: list[str]) -> list[str]:
        """Takes up strings; returns what was put into the memory, in order."""
        known, one, several, cut, many = self.units, [], [], [], []
        for u in units:
            row = PATTERN.findall(u)
            if len(row) == 1:
                one.append(u)
            else:
                several.append(u)
                many.append(len(row))
                cut += row
        missing = np.flatnonzero(known.at(cut) < 0)
        fresh = list(dict.fromkeys(chain(one, (cut[i] for i in missing.tolist()))))
        known.put(fresh, *self.model(pa.array(fresh, pa.large_string())))
        ids, ends = known.get(known.at(cut))
        known.put(several, ids, np.diff(ends[np.cumsum([0, *many])]))
        return fresh + several

    def places(self, units: list[str]) -> tuple[np.ndarray, list[str]]:
        """Places of strings in the memory, and what was put there for them."""
        at, fresh = self.units.at(units), []
        if len(new := np.flatnonzero(at < 0)):
            strings = [units[i] for i in new.tolist()]
            fresh = self.learn(list(dict.fromkeys(strings)))
            at[new] = self.units.at(strings)
        return at, fresh

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of different strings as they stand behind a space, or with the end of a line before them, and how many each has."""
        stems = pc.ascii_rtrim(words, characters=_SIGNS)
        plain = pc.match_substring_regex(stems, _WORD)
        keys = pc.if_else(plain, stems, words).dictionary_encode()
        at = self.words.at(keys.dictionary)
        new = np.flatnonzero(at < 0)
        unseen = keys.dictionary.take(pa.array(new))
        word = pc.match_substring_regex(unseen, _WORD)
        one, other = unseen.filter(word), unseen.filter(pc.invert(word))
        word = word.to_numpy(zero_copy_only=False)
        at[new[word]] = len(self.words.strings) + np.arange(len(one))
        at[new[~word]] = len(self.words.strings) + len(one) + np.arange(len(other))
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), one, pa.scalar("", pa.large_string()))
        self.words.put(one, *self.model(pc.if_else(pc.starts_with(one, "\n"), pc.utf8_slice_codeunits(one, 1), spaced)))
        ends, size = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)[1:], pc.binary_length(stems).to_numpy()
        lens = np.where(plain.to_numpy(zero_copy_only=False), pc.binary_length(words).to_numpy() - size, 0)
        data, cuts = gathered(np.frombuffer(words.buffers()[2] or b"", np.uint8), ends - lens, lens)
        signs = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        odd = [s if s[:1] == "\n" else " " + s for s in other.to_pylist()]
        places, fresh = self.places(["\n", *signs.dictionary.to_pylist(), *odd])
        ids, cuts = self.units.get(places[1 + len(signs.dictionary) :])
        self.words.put(other, ids, np.diff(cuts))
        parts = np.full((len(words), 3), -1)  # the end of a line, the word, the signs
        parts[pc.and_(plain, pc.starts_with(words, "\n")).to_numpy(zero_copy_only=False), 0] = places[0]
        parts[:, 1] = len(self.units.place) + at[keys.indices.to_numpy()]
        parts[:, 2] = np.where(lens > 0, places[1 + signs.indices.to_numpy()], -1)
        has = parts >= 0
        begin = np.concatenate([self.units.first[:-1], len(self.units.flat) + self.words.first[:-1]])
        lens = np.concatenate([np.diff(self.units.first), np.diff(self.words.first)])
        all_of = parts[has]
        ids, cuts = gathered(np.concatenate([self.units.flat, self.words.flat]), begin.take(all_of), lens.take(all_of))
        self.units.forget(fresh)
        self.words.forget(at)
        return ids, np.diff(cuts[np.append(0, np.cumsum(has.sum(1)))])

    def __call__(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        rows = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(rows, _ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(rows, s))
        units: list[str] = []
        told: list[list[tuple[int, int]]] = []  # of each odd text: -1 and a special id, or its first unit and the one after its last
        for text in rows.filter(odd).to_pylist():
            own = []
            for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if i % 2:
                    own.append((-1, self.special[part]))
                elif part:
                    first, *more = _BETWEEN.split(part)
                    own.append((len(units), len(units) + 1 + len(more)))
                    units += [first, *(" " + u for u in more)]
            told.append(own)
        even = rows.filter(pc.invert(odd))
        even = pc.if_else(pc.match_substring_regex(even, _LINES), even, pc.replace_substring(even, "\n", " \n"))
        split = pc.split_pattern(even, " ")
        coded, starts = split.flatten().dictionary_encode(), split.offsets.to_numpy().astype(np.int64)
        index, words = coded.indices.to_numpy(), coded.dictionary
        ids, lens = self.of_words(words)
        heads = words.take(pa.array(index[starts[:-1]])).to_pylist()  # no space stands before the first
        places, fresh = self.places(heads + units)
        at = np.append(index, len(lens) + places[len(heads) :])
        at[starts[:-1]] = len(lens) + places[: len(heads)]
        begin = np.concatenate([np.cumsum(lens) - lens, len(ids) + self.units.first[:-1]])
        ids, cuts = gathered(np.concatenate([ids, self.units.flat]), begin.take(at), np.concatenate([lens, np.diff(self.units.first)]).take(at))
        self.units.forget(fresh)
        ends, behind = cuts[starts].tolist(), cuts[len(index) :]
        plain = (ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        odds = (np.concatenate([np.zeros(0, np.uint32), *(np.array([b], np.uint32) if a < 0 else ids[behind[a] : behind[b]] for a, b in own)]) for own in told)
        return [next(odds) if o else next(plain) for o in odd.to_pylist()]


#: Encoders between the tasks of one worker, by path; one that a task has taken up is not here.
_RESTING: dict[str, Encoder] = {}


def taken_up(path: str) -> Encoder:
    """The encoder of this worker. What a task's own function names of a module is copied to each task, but for functions."""
    return _RESTING.pop(path, None) or Encoder(path)


def laid_down(path: str, encode: Encoder) -> None:
    _RESTING[path] = encode


# On Spark.

FILES = "file int, block int, part int, more boolean, first long, n long, payload binary"


def files(docs: DataFrame, path: str, end: int = 0, text: str = "text", key: str = "doc_id", size: int = BLOCK) -> DataFrame:
    """Rows of the files: the ids of every text and the id `end`, documents in ascending order over all files."""
    rows = prepared(docs, text, key).withColumn("hash", F.xxhash64("text"))
    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc()]
    rows = rows.repartitionByRange(many, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode, file = taken_up(path), TaskContext.get().partitionId()
        number = first = held = 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []

        def told(own: np.ndarray, docs: list, lens: list[int], part: int = 0, more: bool = False) -> pa.RecordBatch:
            nonlocal number, first
            row = [[file], [number], [part], [more], [first], [len(own)], [block(own, docs, lens, part, more)]]
            number, first = number + 1, first + len(own)
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                              names=["file", "block", "part", "more", "first", "n", "payload"])

        def rest() -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs, held
            if docs:
                yield told(np.concatenate(ids), docs, [len(x) for x in ids])
            ids, docs, held = [], [], 0

        for batch in batches:
            for i, j in pieces(batch.column(1), 12 << 20):
                for doc, own in zip(batch.column(0).slice(i, j - i).to_pylist(), encode(pc.fill_null(batch.column(1).slice(i, j - i), "")), strict=True):
                    own = np.append(own, np.uint32(end))
                    if held + len(own) > size:
                        yield from rest()
                    if len(own) > size:
                        for part, at in enumerate(range(0, len(own), size)):
                            piece = own[at : at + size]
                            yield told(piece, [doc], [len(piece)], part, at + size < len(own))
                        continue
                    ids.append(own)
                    docs.append(doc)
                    held += len(own)
        yield from rest()
        laid_down(path, encode)
        release()

    return rows.mapInArrow(run, FILES)


def shifted(crc: int, zeros: int) -> int:
    """The crc32 of a text after as many zero bytes more, without its inversions: a product modulo the polynomial."""

    def times(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if a >> i & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, factor = 1 << 31, 1 << 23  # 1, and x to the 8th
    while zeros:
        if zeros & 1:
            power = times(power, factor)
        factor, zeros = times(factor, factor), zeros >> 1
    return times(power, crc)


def _joined(parts: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Length and checksum of a document from (part, ids, checksum) of its blocks."""
    n = crc = 0
    for _, more, own in sorted(parts):
        crc, n = shifted(crc, 4 * more) ^ own, n + more
    return n, crc


DIRECTORY = T.StructType([T.StructField(n, t) for n, t in (
    ("file", T.IntegerType()), ("block", T.IntegerType()), ("part", T.IntegerType()), ("more", T.BooleanType()), ("doc_id", T.LongType()), ("at", T.LongType()),
    ("n", T.LongType()), ("crc", T.LongType()))])


def read(table: DataFrame, ids: bool = False) -> DataFrame:
    """A row for each document in each block: file, block, part, more, doc_id, at (ids in the file before), n, crc, and with `ids` the ids (little-endian, 32 bits)."""
    schema = T.StructType([*DIRECTORY.fields, *([T.StructField("ids", T.BinaryType())] if ids else [])])
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                file, number, at, data = (batch.column(c)[r].as_py() for c in range(4))
                own, docs, lens, part, more = unblock(data)
                raw = memoryview(own.astype("<u4").tobytes())
                ends = np.append(0, np.cumsum(lens)).tolist()
                cut = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                n = len(docs)
                columns = [[file] * n, [number] * n, [part] * n, [more] * n, docs, [at + e for e in ends[:-1]], lens, [zlib.crc32(c) for c in cut], [bytes(c) for c in cut] if ids else None]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True) if v is not None], names=schema.names)

    return table.select("file", "block", "first", "payload").mapInArrow(run, schema)


def documents(table: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files."""
    own = table.groupBy("file").agg(F.sum("n").alias("n"))  # one small row a file; their running sum is one task's
    offsets = own.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("offset"))
    whole = read(table.where("part = 0 and not more")).select("doc_id", "file", "at", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    several = read(table.where("part > 0 or more")).groupBy("file", (F.col("block") - F.col("part")).alias("head")).agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.collect_list(F.struct("part", "n", "crc")).alias("parts"))  # a part for every million ids
    joined = F.udf(lambda parts: _joined([tuple(p) for p in parts]), "struct<n_tokens:bigint,ids_crc32:bigint>")
    several = several.select("doc_id", "file", "at", joined("parts").alias("j")).select("doc_id", "file", "at", "j.n_tokens", "j.ids_crc32")
    return whole.unionAll(several).join(offsets, "file").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
