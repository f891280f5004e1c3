"""Levels in dBFS, peaks and meters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_DBFS = -96.0


def linear_dbfs(x: Column) -> Column:
    finite = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < float("inf"))
    return F.when(finite, F.greatest(F.lit(FLOOR_DBFS), F.log10(F.when(finite, x)) * 20)).otherwise(F.lit(FLOOR_DBFS))


def power_dbfs(p: Column) -> Column:
    return F.when(p > 1e-12, F.greatest(F.lit(FLOOR_DBFS), F.log10(F.when(p > 1e-12, p)) * 10)).otherwise(F.lit(FLOOR_DBFS))


def noise_percent(dbfs: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (dbfs + 72) / 66 * 100))


def peak_note(peak: Column) -> Column:
    finite = peak.isNotNull() & ~F.isnan(peak) & (peak > 0) & (peak < float("inf"))
    return F.when(finite & (peak > 0.92), "clip").when(finite & (peak < 0.04), "quiet")


def rms(samples: Column) -> Column:
    """Squares are summed in double, float32 would lose the quiet ones."""
    total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(F.lit(0.0))


def is_speech_level(level: Column, threshold_dbfs: float) -> Column:
    return level > F.lit(10.0 ** (threshold_dbfs / 20.0))


def bin_envelope(samples: Column) -> Column:
    """(lo, hi) of clamped samples; both start at 0, so a one-sided bin touches the axis."""
    clamped = F.transform(samples, lambda x: F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), x)))
    zero = F.lit(0.0).cast("float")
    return F.struct(
        F.least(zero, F.coalesce(F.array_min(clamped), zero)).alias("lo"),
        F.greatest(zero, F.coalesce(F.array_max(clamped), zero)).alias("hi"))


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(0.0))


def channel_mean(channels: Column) -> Column:
    """Mono mix of an array of equally long channels; a missing sample counts as 0."""
    n = F.size(channels)
    first = F.element_at(channels, 1)
    return F.when(n == 0, F.array().cast("array<double>")).otherwise(
        F.transform(first, lambda _x, i: F.aggregate(
            channels, F.lit(0.0), lambda acc, c: acc + F.coalesce(F.get(c, i).cast("double"), F.lit(0.0))) / n))


def resample(samples: Column, from_rate: Column, to_rate: Column) -> Column:
    """Linear resampling of one bounded block."""
    ratio = from_rate / to_rate
    n = F.size(samples)
    out = F.greatest(F.lit(1), F.floor(n / ratio + F.lit(0.5)).cast("int"))
    last = n - 1

    def at(i):
        source = i * ratio
        left = F.least(last, F.floor(source).cast("int"))
        right = F.least(last, left + 1)
        mix = source - left
        return F.get(samples, left).cast("double") * (F.lit(1.0) - mix) + F.get(samples, right).cast("double") * mix

    bad = (n == 0) | (from_rate <= 0) | (to_rate <= 0)
    same = from_rate == to_rate
    return (F.when(bad, F.array().cast("array<double>"))
            .when(same, F.transform(samples, lambda x: x.cast("double")))
            .otherwise(F.transform(F.sequence(F.lit(0), out - 1), at)))
