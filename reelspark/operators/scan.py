"""Running values per key that never put a whole key into one task.

A plain ``Window.partitionBy(session).orderBy(position)`` sorts a full session in one
task, so one long recording stalls the job. Here the order is cut into chunks:

1. rows are windowed per (key, chunk), so a task orders one chunk at a time;
2. each chunk is reduced to one summary row (sums, last values, ...);
3. the summaries, one per chunk, are windowed per key to give each chunk its carry;
4. the carry is joined back on (key, chunk) and added to the in-chunk value.

The chunk column must be monotone in the order, e.g. ``seq div width`` or a time slice;
with a unique sequence a chunk holds at most ``width`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_of(position: Column | str, width: int) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(width)).cast("long")


@dataclass
class Scan:
    """What to carry along the order; every output covers the rows *before* this one.

    lag   value of the previous row (null values are kept, first row is null)
    total sum over all previous rows, 0 when there are none
    top   maximum over all previous rows, null when there are none
    last  last non-null value among the previous rows
    run   (value, reset, keep): sum of value since the last row where reset holds,
          that row's own value counted only if keep; the whole prefix while nothing was reset
    """

    lag: dict[str, Column] = field(default_factory=dict)
    total: dict[str, Column] = field(default_factory=dict)
    top: dict[str, Column] = field(default_factory=dict)
    last: dict[str, Column] = field(default_factory=dict)
    run: dict[str, tuple[Column, Column, Column]] = field(default_factory=dict)

    def outputs(self) -> list[str]:
        return [*self.lag, *self.total, *self.top, *self.last, *self.run]


def _inside(df: DataFrame, keys, order, chunk, spec: Scan) -> DataFrame:
    """In-chunk values; the raw inputs stay next to them for the summaries."""
    by = Window.partitionBy(*keys, chunk).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    cols = []
    for name, value in spec.lag.items():
        # boxed, so that a null value of the previous row differs from no previous row
        cols += [F.struct(value.alias("v")).alias(f"_{name}_x")]
    for name, value in [*spec.total.items(), *spec.top.items(), *spec.last.items()]:
        cols += [value.alias(f"_{name}_x")]
    for name, (value, reset, keep) in spec.run.items():
        value = F.coalesce(value, F.lit(0)).cast("long")
        cols += [value.alias(f"_{name}_x"), F.coalesce(reset, F.lit(False)).alias(f"_{name}_r"),
                 F.when(F.coalesce(keep, F.lit(False)), F.lit(0)).otherwise(value).alias(f"_{name}_o")]
    df = df.select("*", *cols)

    cols = []
    for name in spec.lag:
        cols += [F.lag(f"_{name}_x").over(by).alias(f"_{name}_in")]
    for name in spec.total:
        cols += [F.coalesce(F.sum(f"_{name}_x").over(before), F.lit(0)).alias(f"_{name}_in")]
    for name in spec.top:
        cols += [F.max(f"_{name}_x").over(before).alias(f"_{name}_in")]
    for name in spec.last:
        cols += [F.last(f"_{name}_x", ignorenulls=True).over(before).alias(f"_{name}_in")]
    for name in spec.run:
        cols += [F.coalesce(F.sum(f"_{name}_x").over(before), F.lit(0)).alias(f"_{name}_in")]
    df = df.select("*", *cols)
    if spec.run:
        # prefix sum at the last reset row
        df = df.select("*", *[
            F.last(F.when(F.col(f"_{n}_r"), F.col(f"_{n}_in") + F.col(f"_{n}_o")), ignorenulls=True)
            .over(before).alias(f"_{n}_base") for n in spec.run])
    return df


def _summaries(inside: DataFrame, keys, order, chunk, spec: Scan) -> DataFrame:
    pos = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    aggs = []
    for name in spec.lag:
        aggs += [F.max_by(F.col(f"_{name}_x"), pos).alias(f"_{name}_c")]
    for name in spec.total:
        aggs += [F.coalesce(F.sum(f"_{name}_x"), F.lit(0)).alias(f"_{name}_c")]
    for name in spec.top:
        aggs += [F.max(f"_{name}_x").alias(f"_{name}_c")]
    for name in spec.last:
        aggs += [F.max_by(F.col(f"_{name}_x"), F.when(F.col(f"_{name}_x").isNotNull(), pos)).alias(f"_{name}_c")]
    for name in spec.run:
        through_reset = F.col(f"_{name}_in") + F.col(f"_{name}_o")
        aggs += [F.sum(f"_{name}_x").alias(f"_{name}_c"),
                 F.max_by(through_reset, F.when(F.col(f"_{name}_r"), pos)).alias(f"_{name}_b")]
    return inside.groupBy(*keys, chunk).agg(*aggs)


def _carries(summaries: DataFrame, keys, chunk, spec: Scan) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(chunk)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    cols = [*keys, chunk]
    for name in spec.lag:
        cols += [F.lag(f"_{name}_c").over(by).alias(f"_{name}_k")]
    for name in spec.total:
        cols += [F.coalesce(F.sum(f"_{name}_c").over(before), F.lit(0)).alias(f"_{name}_k")]
    for name in spec.top:
        cols += [F.max(f"_{name}_c").over(before).alias(f"_{name}_k")]
    for name in spec.last:
        cols += [F.last(f"_{name}_c", ignorenulls=True).over(before).alias(f"_{name}_k")]
    for name in spec.run:
        cols += [F.coalesce(F.sum(f"_{name}_c").over(before), F.lit(0)).alias(f"_{name}_t"),
                 F.col(f"_{name}_b")]
    out = summaries.select(*cols)
    if spec.run:
        for name in spec.run:
            base = F.last(F.col(f"_{name}_t") + F.col(f"_{name}_b"), ignorenulls=True).over(before)
            out = out.withColumn(f"_{name}_k", F.col(f"_{name}_t") - F.coalesce(base, F.lit(0)))
        out = out.drop(*[f"_{n}_t" for n in spec.run], *[f"_{n}_b" for n in spec.run])
    return out


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: str, spec: Scan) -> DataFrame:
    """Adds the outputs of ``spec`` to ``df``; ``chunk`` names its chunk column.

    The result stays partitioned by (keys, chunk), so a second scan over the same
    columns sorts nothing anew.
    """
    inside = _inside(df, keys, order, chunk, spec)
    carries = _carries(_summaries(inside, keys, order, chunk, spec), keys, chunk, spec)
    return _finish(df.columns, inside, carries, keys, chunk, spec)


def _finish(source: list[str], inside: DataFrame, carries: DataFrame, keys: list[str], chunk: str, spec: Scan) -> DataFrame:
    joined = inside.join(carries, [*keys, chunk], "left")

    cols = []
    for name in spec.lag:
        cols += [F.coalesce(F.col(f"_{name}_in"), F.col(f"_{name}_k"))["v"].alias(name)]
    for name in spec.total:
        cols += [(F.col(f"_{name}_in") + F.coalesce(F.col(f"_{name}_k"), F.lit(0))).alias(name)]
    for name in spec.top:
        cols += [F.greatest(f"_{name}_in", f"_{name}_k").alias(name)]
    for name in spec.last:
        cols += [F.coalesce(f"_{name}_in", f"_{name}_k").alias(name)]
    for name in spec.run:
        cols += [F.when(F.col(f"_{name}_base").isNotNull(), F.col(f"_{name}_in") - F.col(f"_{name}_base"))
                 .otherwise(F.col(f"_{name}_in") + F.coalesce(F.col(f"_{name}_k"), F.lit(0))).alias(name)]
    return joined.select(*source, *cols)
