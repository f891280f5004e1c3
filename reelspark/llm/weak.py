"""Quality rules as weak supervision.

Each rule votes good or bad on a document or abstains. Expectation-maximisation over the counts of vote patterns
estimates how often each rule votes right on good and on bad documents, and the posterior probability of a good
document takes the place of a filter that every rule must pass. All of it is built-in column functions.

The pattern counts, at most 3 ** len(RULES) rows at any corpus size, are all that comes to the driver. Null text
counts as empty; it has no words and fails the base. Rows that are repeated count each time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# White space between words, and the symbols.
SPACES = " \\t\\n\\x0B\\f\\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Words of a block in which distinct words are counted; long texts repeat words, so the whole text is no measure.
BLOCK = 100
STEPS = 60

#: Name, bad when, good when (false: it votes bad or abstains). The figures are per word, line or letter.
RULES: tuple[tuple[str, str, str], ...] = (
    ("plain", "n_plain < 0.6 * n_words", "n_plain > 0.85 * n_words"),
    ("symbols", "n_symbols > 0.1 * n_words", "false"),
    ("marks", "n_symbols + n_shouts > 0.02 * word_chars", "false"),
    ("capitals", "n_capitals > 0.3 * word_chars", "false"),
    ("shouts", "n_shouts > 0.1 * n_words", "false"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "false"),
    ("repeats", "n_repeat_words > 0.3 * n_words", "n_repeat_words = 0 and n_words >= 50"),
    ("distinct", "n_distinct < 0.25 * n_words", "n_distinct > 0.6 * n_words"),
    ("length", "word_chars < 2.5 * n_words or word_chars > 12 * n_words", "false"),
)
#: A rule is taken to vote bad at least so many times as often on bad documents as on good ones.
BETTER = 8.0


def window_hashes(words: str) -> Column:
    w = F.col(words)
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW)))
    none = F.array().cast("array<bigint>")
    return F.when(n >= WINDOW, hashes).otherwise(none)


def distinct_words(words: str) -> Column:
    """Distinct words of each block of BLOCK words, summed over all blocks."""
    w = F.col(words)
    last = F.greatest(F.lit(0), F.ceil(F.size(w) / BLOCK).cast("int") - 1)
    return F.aggregate(F.sequence(F.lit(0), last), F.lit(0).cast("long"), lambda s, i: s + F.size(F.array_distinct(F.slice(w, i * BLOCK + 1, BLOCK))))


def statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The counts that the rules and the base read, one row a document."""
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    base = base.withColumns({
        "words": F.array_remove(F.split("text", f"[{SPACES}]+"), ""),
        "lines": F.filter(F.split("text", "\\n"), lambda x: x.rlike(f"[^{SPACES}]")),
    })
    base = base.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"),
        F.regexp_count("text", F.lit(f"(?:^|[{SPACES}])\\p{{Lu}}?\\p{{Ll}}*[.,;:?]?(?=[{SPACES}]|$)")).cast("long").alias("n_plain"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        distinct_words("words").alias("n_distinct"), window_hashes("words").alias("windows"))
    base = base.drop("words").withColumn("repeats", F.size(F.array_distinct("windows")) < F.size("windows"))
    placed = F.when(F.col("repeats"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    base = base.withColumn("placed", placed).drop("windows")
    # Places of windows whose hash the neighbour in this order shares.
    p = F.col("placed")
    same = lambda x, i: F.coalesce(x["h"] == F.get(p, i)["h"], F.lit(False))
    twice = F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1))
    base = base.withColumn("at", F.when(F.col("repeats"), F.array_sort(F.transform(twice, lambda x: x["i"])))).drop("placed")
    a = F.col("at")
    covered = F.aggregate(F.transform(a, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(a, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    return base.withColumn("n_repeat_words", F.when(F.col("repeats"), covered).otherwise(0).cast("long")).drop("at", "repeats")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def votes(stats: DataFrame) -> DataFrame:
    """Adds a column for each rule: 1 good, 0 bad, null abstains."""
    return stats.withColumns({f"vote_{name}": F.when(F.expr(bad), 0).when(F.expr(good), 1).otherwise(None) for name, bad, good in RULES})


def estimate(patterns: list[tuple[tuple[int | None, ...], int]]) -> dict:
    """Share of good documents, and for each rule and class the chances of a bad vote, a good vote and none."""
    rate = [([0.4, 0.3, 0.3], [0.02, 0.6, 0.38]) for _ in RULES]  # on bad and on good documents
    prior, total = 0.8, sum(n for _, n in patterns)
    for _ in range(STEPS if total else 0):
        sums = [([1.0, 1.0, 1.0], [1.0, 1.0, 1.0]) for _ in RULES]
        good = 1.0
        for vote, n in patterns:
            p = posterior(vote, prior, rate)
            good += n * p
            for s, v in zip(sums, vote, strict=True):
                k = 2 if v is None else v
                s[0][k] += n * (1 - p)
                s[1][k] += n * p
        prior = min(0.999, max(0.001, good / (total + 2)))
        rate = []
        for bad, fine in sums:
            b, g = [x / sum(bad) for x in bad], [x / sum(fine) for x in fine]
            g[0] = min(g[0], b[0] / BETTER)
            b[1] = min(b[1], g[1])
            rate.append((b, g))
    return {"prior": prior, "rate": rate}


def posterior(vote: tuple[int | None, ...], prior: float, rate: list) -> float:
    odds = math.log(prior / (1 - prior))
    for v, (bad, good) in zip(vote, rate, strict=True):
        k = 2 if v is None else v
        odds += math.log(good[k] / bad[k])
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def fit(voted: DataFrame) -> dict:
    names = [f"vote_{name}" for name, _, _ in RULES]
    rows = voted.groupBy(*names).count().collect()
    return estimate(sorted(((tuple(r[n] for n in names), r["count"]) for r in rows), key=str))


def probability(model: dict) -> Column:
    """Posterior probability that a voted row is good."""
    odds = F.lit(math.log(model["prior"] / (1 - model["prior"])))
    for (name, _, _), (bad, good) in zip(RULES, model["rate"], strict=True):
        v = F.col(f"vote_{name}")
        worth = [math.log(good[k] / bad[k]) for k in range(3)]
        odds = odds + F.when(v == 0, worth[0]).when(v == 1, worth[1]).otherwise(worth[2])
    return 1 / (1 + F.exp(-odds))


def judge(stats: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds p_good, base_failed and kept to a table of statistics, which is read twice: write it first."""
    voted = votes(stats)
    model = fit(voted)
    return voted.withColumns({"p_good": probability(model), "base_failed": base_failed()}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
