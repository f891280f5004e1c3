"""Quality classifier: naive Bayes features in a linear support vector machine.

A text becomes indicators of n-grams (1 to 3) of word forms: the shape of each word, with its punctuation as it
stands and a mark where a word repeats the one before. Indicators of n-grams (1 and 2) of the words themselves, in
lower case and without punctuation around them, have buckets of their own. Each indicator is scaled by the log ratio of its class
counts. The hinge loss (squared) is minimised by dual coordinate descent.

The classifier is learned from a bounded sample: about SAMPLE labelled ids, chosen by their hash before any text is
read, and of those the first whose features fit in SAMPLE_BYTES. Only these ids are broadcast, and only their features come
to the driver. The last quarter sets the scale of the score.

Null and empty texts have no n-grams and are scored by the intercept. Labels that are neither 0 nor 1 are left out, an
id with labels of both kinds as well; an id with one label several times counts once. Rows that repeat an id are learned
from each. Without rows of both classes the score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import re
import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from reelspark.llm.common import map_rows, prepared, written

SHAPES, VOCABULARY = 1 << 16, 1 << 18
#: Indicators: those of shapes, then those of words.
BUCKETS = SHAPES + VOCABULARY
#: Labelled ids that the machine is fitted on, and bytes of their features at most.
SAMPLE, SAMPLE_BYTES = 16_000, 96 << 20
ROUNDS = 8
COST = 0.1
#: Words that a task remembers, and the longest of them.
MEMORY, REMEMBERED = 300_000, 64
_AROUND = re.compile(r"^[\W_]+|[\W_]+$")
_RUNS = re.compile(r"[^\W\d_]+|\d+|[\W_]")


def form(word: str) -> str:
    """Shape of a word: letters by case and rough length, digits, symbols as they stand, long runs cut."""
    out = []
    for run in _RUNS.findall(word):
        if run[0].isalpha():
            case = "X" if len(run) > 1 and run.isupper() else "C" if run[0].isupper() else "x"
            out.append(case + ("1" if len(run) < 4 else "2" if len(run) < 16 else "3"))
        elif run[0].isdigit():
            out.append("9" if len(run) < 3 else "99")
        else:
            out.append(run)
    kept = [r for i, r in enumerate(out) if i < 3 or r != out[i - 3]]
    return "".join(kept[:6])


def mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


class Features:
    """Sorted buckets of a text's indicators, as little-endian 32-bit integers."""

    def __init__(self):
        self.memory: dict[str, tuple[int, int]] = {}

    def word(self, w: str) -> tuple[int, int]:
        """Hashes of the word's shape and of the word itself."""
        h = 1469598103934665603
        for b in form(w).encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
        bare = _AROUND.sub("", w.lower()) or w
        both = h, xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass"))
        if len(w) <= REMEMBERED:
            self.memory[w] = both
        return both

    def __call__(self, texts: list[str]) -> dict[str, list[bytes]]:
        if len(self.memory) > MEMORY:
            self.memory = {}
        get, out = self.memory.get, []
        for text in texts:
            words = text.split()
            if not words:
                out.append(b"")
                continue
            h, own = np.array([get(w) or self.word(w) for w in words], np.uint64).T.copy()
            h[1:][np.array([a == b for a, b in zip(words[1:], words[:-1], strict=True)], bool)] ^= np.uint64(0x5BD1E995)
            found = [mix(h)]
            for n in (2, 3):
                if len(h) >= n:
                    g = np.full(len(h) - n + 1, n, np.uint64)
                    for i in range(n):
                        g = mix(g ^ h[i : i + len(g)])
                    found.append(g)
            vocabulary = [mix(own), mix(mix(own[:-1]) ^ own[1:] ^ np.uint64(2))]
            made = np.concatenate([np.concatenate(found) % np.uint64(SHAPES), np.concatenate(vocabulary) % np.uint64(VOCABULARY) + np.uint64(SHAPES)])
            out.append(np.unique(made).astype("<u4").tobytes())
        return {"features": out}


def featurise(docs: DataFrame, text: str = "text") -> DataFrame:
    return map_rows(docs, text, [T.StructField("features", T.BinaryType())], Features, most=1 << 20)


def chosen(labels: DataFrame, key: str = "doc_id", label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """doc_id and y of about `most` labelled ids, those with the smallest hashes: all where there are fewer."""
    own = labels.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    n = own.count()
    if n > most:
        own = own.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 1) < int(most / n * 2**63))
    return own.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").select("doc_id", "y")


def sample(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """doc_id, y and features of the documents whose ids are chosen, written; texts stay where they lie."""
    ids = F.broadcast(chosen(labels, key, label, most).limit(2 * most))  # the limit only proves the size
    return written(featurise(prepared(docs, text, key).join(ids, "doc_id")).drop("text"), "sample")


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; y is -1 or 1, `weight` scales a row's cost."""
    w, b = np.zeros(len(r)), 0.0
    alpha = np.zeros(len(rows))
    x = [r[f] for f in rows]
    diagonal = 0.5 / (COST * weight)
    square = np.array([v @ v for v in x]) + 1 + diagonal
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for i in order.permutation(len(rows)).tolist():
            g = y[i] * (w[rows[i]] @ x[i] + b) - 1 + diagonal[i] * alpha[i]
            if (new := max(0.0, alpha[i] - g / square[i])) != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                b += step
                alpha[i] = new
    return w, b


def sigmoid_scale(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve that turns margins into a score (Newton steps)."""
    a, b = 1.0, 0.0
    soft = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, v = p - soft, p * (1 - p) + 1e-9
        grad = np.array([g @ margin + 1e-3 * (a - 1), g.sum()])
        hess = np.array([[v @ margin**2 + 1e-3, v @ margin], [v @ margin, v.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: DataFrame, most_bytes: int = SAMPLE_BYTES) -> dict:
    """From `sample`'s rows, each (id, features) once; `most_bytes` of features come to the driver at most."""
    none = {"w": np.zeros(BUCKETS), "b": 0.0, "scale": (0.0, 0.0)}
    rows = rows.select("features", "y", F.shiftrightunsigned(F.xxhash64("doc_id", "features"), 1).alias("by")).dropDuplicates(["by"])
    total = rows.agg(F.sum(F.octet_length("features"))).first()[0] or 0
    if total > most_bytes:
        rows = rows.where(F.col("by") < int(most_bytes / total * 2**63))
    table = rows.toArrow().sort_by("by")
    x = [np.frombuffer(s, "<u4") for s in table.column("features").to_pylist()]
    y = table.column("y").to_numpy().astype(int)
    good = int(y.sum())
    none["scale"] = (0.0, float(np.log((good + 1) / (len(y) - good + 1))))
    cut = len(x) * 3 // 4
    if len({*y[:cut]}) < 2 or len({*y[cut:]}) < 2:
        cut = len(x)
    if len({*y[:cut]}) < 2:
        return none
    n = np.full((2, BUCKETS), 0.5)
    for f, label in zip(x[:cut], y[:cut].tolist(), strict=True):
        n[label, f] += 1
    share = y[:cut].mean()
    r = np.log(n[1] / (share * cut + 1)) - np.log(n[0] / ((1 - share) * cut + 1))
    w, b = descend(x[:cut], np.where(y[:cut] == 1, 1.0, -1.0), r, np.where(y[:cut] == 1, 0.5 / share, 0.5 / (1 - share)))
    w = w * r
    test = slice(cut, None) if cut < len(x) else slice(None)
    margin = np.array([w[f].sum() + b for f in x[test]])
    return {"w": w, "b": b, "scale": sigmoid_scale(margin, y[test] == 1)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Adds the score, 0 to 1, to rows with features."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        a, b = m["scale"]

        def run(lists: list) -> dict[str, list[float]]:
            margin = np.array([m["w"][np.frombuffer(x, "<u4")].sum() if x else 0.0 for x in lists]) + m["b"]
            return {"score": (1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))).tolist()}

        return run

    return map_rows(docs, "features", [T.StructField("score", T.DoubleType())], make, most=1 << 20)
