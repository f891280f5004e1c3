"""The sample timeline: segments, takes, bins and frames.

Intervals are half-open. Closed segments have one fixed length L, so a take names the
segments it touches by arithmetic and the range join becomes an equi join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.functions import levels
from reelspark.operators.scan import Scan, chunk_of, scan

C = F.col
BIN = 64
# Fixed values of the bandwidth test.
RING, FFT, HOP = 16_384, 2_048, 1_024
MID_HZ, HIGH_HZ = (2_000.0, 6_000.0), (8_000.0, 16_000.0)
MIN_MID_DBFS, MIN_RATIO_DB = -70.0, -30.0
VAD_RATE, VAD_FRAME = 16_000, 256


def take_parts(takes: DataFrame, segments: DataFrame, frames_per_segment: int) -> DataFrame:
    """One row per (take, touched segment); parts of a missing segment are null.

    ``takes`` needs session_id, start_sample, end_sample and its own key columns.
    """
    length = F.lit(frames_per_segment)
    ok = C("end_sample") > C("start_sample")
    first = F.floor(C("start_sample") / length).cast("long")
    last = F.floor((C("end_sample") - 1) / length).cast("long")
    touched = F.when(ok, F.sequence(first, last))
    takes = takes.select("*", F.explode_outer(touched).alias("segment_index"))
    seg = segments.select("session_id", "segment_index", "global_start_frame", C("frames").alias("segment_frames"))
    rows = takes.join(seg, ["session_id", "segment_index"], "left")
    lo = F.greatest("start_sample", "global_start_frame")
    hi = F.least(C("end_sample"), C("global_start_frame") + C("segment_frames"))
    hit = C("global_start_frame").isNotNull() & (hi > lo)
    return rows.withColumn("part_start", F.when(hit, lo)).withColumn("part_frames", F.when(hit, hi - lo)).withColumn(
        "local_start", F.when(hit, lo - C("global_start_frame")))


def take_coverage(takes: DataFrame, segments: DataFrame, frames_per_segment: int, keys: list[str]) -> DataFrame:
    """One row per take: mapped frames and why it cannot be cut, if so."""
    parts = take_parts(takes, segments, frames_per_segment)
    out = parts.groupBy("session_id", *keys, "start_sample", "end_sample").agg(
        F.count("part_frames").alias("parts"), F.coalesce(F.sum("part_frames"), F.lit(0)).cast("long").alias("mapped_frames"))
    error = F.when(C("end_sample") <= C("start_sample"), "empty_range").when(
        C("mapped_frames") != C("end_sample") - C("start_sample"), "not_covered")
    return out.withColumn("error", error)


def points_in_takes(points: DataFrame, takes: DataFrame, width: int) -> DataFrame:
    """Adds ``in_take`` to points (session_id, sample): does any take hold the sample?

    Some take starting at or before the sample must end after it, so a running maximum of
    the ends decides. No pair is formed, however many takes overlap; a null end is open.
    A sample enters the scan twice at most, as a start and as a point, whatever stands on it,
    so a chunk holds two rows a sample.
    """
    open_end = F.lit(2**62).cast("long")
    starts = takes.groupBy("session_id", C("start_sample").alias("sample")).agg(F.max(F.coalesce("end_sample", open_end)).alias("end_sample")).withColumn("kind", F.lit(0))
    asked = points.select("session_id", "sample").distinct().withColumn("kind", F.lit(1))
    rows = asked.unionByName(starts, allowMissingColumns=True).withColumn("chunk", chunk_of("sample", width))
    rows = scan(rows, ["session_id"], ["sample", "kind"], "chunk", Scan(top={"reach": C("end_sample")}))
    told = rows.where("kind = 1").select("session_id", "sample", F.coalesce(C("reach") > C("sample"), F.lit(False)).alias("in_take"))
    return points.join(told, ["session_id", "sample"], "left").select(*points.columns, "in_take")


def numbering_gaps(segments: DataFrame, width: int) -> DataFrame:
    """First segment per session whose number is not its position counted from 1."""
    rows = scan(segments.withColumn("chunk", chunk_of("segment_index", width)), ["session_id"], ["segment_index"], "chunk",
                Scan(total={"before": F.lit(1)}))
    return rows.where(C("segment_index") != C("before") + 1).groupBy("session_id").agg(
        F.min("segment_index").alias("first_wrong_index"), F.count(F.lit(1)).alias("wrong_segments"))


def global_offsets(segments: DataFrame, frames_per_segment: int, width: int) -> DataFrame:
    """Adds each segment's start on the session timeline and its layout error."""
    rows = scan(segments.withColumn("chunk", chunk_of("segment_index", width)), ["session_id"], ["segment_index"], "chunk",
                Scan(total={"global_start_frame": C("frames")}))
    ends = segments.groupBy("session_id").agg(F.max("segment_index").alias("last_index"))
    rows = rows.join(ends, "session_id")
    is_last = C("segment_index") == C("last_index")
    error = (F.when(~is_last & (C("frames") != frames_per_segment), "closed_length")
             .when(is_last & (C("frames") > frames_per_segment), "too_long"))
    return rows.withColumn("layout_error", error).drop("chunk", "last_index")


def provenance_valid(spans: DataFrame, committed: DataFrame, width: int) -> DataFrame:
    """Do a session's spans tile [0, committed) without gap? No span at all is valid."""
    rows = scan(spans.withColumn("chunk", chunk_of("span", width)), ["session_id"], ["span"], "chunk", Scan(lag={"prev_end": C("end_sample")}))
    joined = rows.groupBy("session_id").agg(
        F.bool_and((C("start_sample") == F.coalesce("prev_end", F.lit(0))) & (C("end_sample") >= C("start_sample"))).alias("tiled"),
        F.max_by("end_sample", "span").alias("cursor"))
    out = committed.join(joined, "session_id", "left")
    return out.select("session_id", F.coalesce(C("tiled") & (C("cursor") == C("committed_samples")), F.lit(True)).alias("provenance_valid"))


def physical_totals(segments: DataFrame, bytes_per_frame: int, header: int) -> DataFrame:
    return segments.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("frames").alias("physical_frames"),
        F.sum(C("frames") * bytes_per_frame + header).alias("file_bytes"))


def envelope(blocks: DataFrame) -> DataFrame:
    """(lo, hi) per 64-sample bin of the timeline; blocks may straddle bins."""
    first = F.floor(C("block_start") / BIN).cast("long")
    last = F.floor((C("block_end") - 1) / BIN).cast("long")
    rows = blocks.where(C("block_end") > C("block_start")).select("session_id", "block_start", "block_end", "samples", F.explode(F.sequence(first, last)).alias("bin"))
    lo = F.greatest(C("bin") * BIN, C("block_start"))
    n = F.least((C("bin") + 1) * BIN, C("block_end")) - lo
    part = F.slice("samples", (lo - C("block_start") + 1).cast("int"), n.cast("int"))
    rows = rows.select("session_id", "bin", n.alias("n"), levels.bin_envelope(part).alias("e"))
    return rows.groupBy("session_id", "bin").agg(F.sum("n").alias("samples"), F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi"))


def bin_peaks(bins: DataFrame) -> DataFrame:
    a = F.greatest(F.abs(levels.finite_or_zero(C("lo").cast("double"))), F.abs(levels.finite_or_zero(C("hi").cast("double"))))
    return bins.groupBy("session_id").agg(F.max(a).alias("bin_peak"))


def take_peak(bins: DataFrame, stored: DataFrame) -> DataFrame:
    """Largest of the bin peak, the stored and the live peak; non-finite ones count as 0."""
    rows = stored.join(bin_peaks(bins), "session_id", "left")
    return rows.select("session_id", F.greatest(
        F.coalesce("bin_peak", F.lit(0.0)), levels.finite_or_zero(C("stored_peak")), levels.finite_or_zero(C("live_peak"))).alias("peak"))


def resample_blocks(blocks: DataFrame, from_rate: int, to_rate: int) -> DataFrame:
    """Linear resampling of a session's contiguous blocks (session_id, block_start, block_end, samples) as one stream.

    Output k lies at sample k * from_rate / to_rate of the session. A block makes those that begin in it; the
    one sample it needs beyond its end comes from the next block by an equi join. An output without a right
    neighbour isn't made. Adds ``first``, the number of the first output, and ``resampled``.
    """
    halo = blocks.select("session_id", C("block_start").alias("block_end"), F.get("samples", F.lit(0)).cast("double").alias("_next"))
    rows = blocks.join(halo, ["session_id", "block_end"], "left")
    ceil = lambda c: F.floor((c * to_rate + (from_rate - 1)) / from_rate).cast("long")

    def output(k: Column) -> Column:
        place = k * from_rate
        rest = F.pmod(place, F.lit(to_rate))
        i = ((place - rest) / to_rate - C("block_start")).cast("int")
        left, right = F.get("samples", i).cast("double"), F.coalesce(F.get("samples", i + 1).cast("double"), C("_next"))
        return F.when(rest == 0, F.when(right.isNotNull(), left)).otherwise(left + (right - left) * (rest / to_rate))

    first, after = ceil(C("block_start")), ceil(C("block_end"))
    made = F.when(after > first, F.array_compact(F.transform(F.sequence(first, after - 1), output))).otherwise(F.array().cast("array<double>"))
    return rows.select(*blocks.columns, first.alias("first"), made.alias("resampled"))


def contiguous_blocks(blocks: DataFrame, width: int) -> DataFrame:
    """Closes the gaps: every block starts where the previous one of its session ended."""
    rows = scan(blocks.withColumn("chunk", chunk_of("seq", width)), ["session_id"], ["seq"], "chunk",
                Scan(total={"before": F.size("samples").cast("long")}))
    return rows.withColumn("block_start", C("before")).withColumn("block_end", C("before") + F.size("samples")).drop("before", "chunk")


def newest_samples(blocks: DataFrame, width: int, limit: int = RING) -> DataFrame:
    """The newest ``limit`` finite samples per session as one bounded array."""
    finite = F.filter(C("samples"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = blocks.select("session_id", "seq", finite.alias("samples")).where(F.size("samples") > 0)
    rows = rows.withColumn("back", -C("seq"))
    rows = scan(rows.withColumn("chunk", chunk_of("back", width)), ["session_id"], ["back"], "chunk",
                Scan(total={"newer": F.size("samples").cast("long")}))
    kept = rows.where(C("newer") < limit).groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "samples"))).alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: p["samples"]))
    clamp = F.transform(flat, lambda x: F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), x)))
    skip = F.greatest(F.lit(0), F.size(clamp) - limit)
    return kept.select("session_id", F.slice(clamp, skip + 1, limit).alias("samples"))


def _band_powers(rate: int):
    hz = np.arange(FFT // 2 + 1) * (rate / FFT)
    inner = (np.arange(FFT // 2 + 1) >= 1) & (np.arange(FFT // 2 + 1) < FFT // 2)
    mid = inner & (hz >= MID_HZ[0]) & (hz < MID_HZ[1])
    high = inner & (hz >= HIGH_HZ[0]) & (hz < HIGH_HZ[1])
    hann = np.hanning(FFT)

    @F.pandas_udf("mid double, high double")
    def powers(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in frames:
            if len(s) == 0:
                yield pd.DataFrame({"mid": [], "high": []}, dtype="float64")
                continue
            spectrum = np.abs(np.fft.rfft(np.stack(s.to_numpy()).astype(np.float64) * hann, axis=1)) ** 2
            yield pd.DataFrame({"mid": spectrum[:, mid].sum(axis=1), "high": spectrum[:, high].sum(axis=1)})

    return powers


def bandwidth_verdict(blocks: DataFrame, rate: int, width: int) -> DataFrame:
    """Does the newest audio reach the high band, or was it low-passed on the way?

    Spark finds the newest samples and cuts the frames; only the spectrum of a frame is
    computed in an Arrow function.
    """
    newest = newest_samples(blocks, width)
    n = F.size("samples")
    offsets = F.when(n >= FFT, F.sequence(F.lit(0), n - FFT, F.lit(HOP)))
    frames = newest.select("session_id", F.explode(offsets).alias("o"), "samples").select(
        "session_id", F.slice("samples", C("o") + 1, FFT).alias("frame"))
    power = frames.select("session_id", _band_powers(rate)("frame").alias("p")).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("frames"), F.avg("p.mid").alias("mid"), F.avg("p.high").alias("high"))
    rows = newest.select("session_id", n.cast("long").alias("samples")).join(power, "session_id", "left")
    loud = F.coalesce(levels.power_dbfs(C("mid")) >= MIN_MID_DBFS, F.lit(False))
    conclusive = F.lit(rate >= 44_100 and rate / 2 > 12_000) & (C("samples") >= FFT) & loud
    ratio = F.when((C("mid") <= 0) | (C("high") <= 0), F.lit(-96.0)).otherwise(F.log10(C("high") / C("mid")) * 10)
    rows = rows.select("session_id", "samples", conclusive.alias("conclusive"), F.when(conclusive, ratio).alias("ratio_db"))
    return rows.withColumn("passed", ~C("conclusive") | (C("ratio_db") > MIN_RATIO_DB))


def speech_frames(blocks: DataFrame, rate: int) -> DataFrame:
    """16 ms analysis frames of contiguous blocks: source range and valid samples.

    Resampled position n sits at source n * step; it needs its right neighbour, so the
    last source sample yields none. Every block finds its own positions, a frame then
    combines those of the blocks it spans.
    """
    step = rate / VAD_RATE
    ends = blocks.groupBy("session_id").agg(F.max("block_end").alias("total"))
    first = F.ceil(C("block_start") / F.lit(step)).cast("long")
    stop = F.ceil(F.least(C("block_end"), C("total") - (0 if rate == VAD_RATE else 1)) / F.lit(step)).cast("long")
    rows = blocks.join(ends, "session_id").select("session_id", first.alias("a"), stop.alias("z")).where("z > a")
    frame = F.explode(F.sequence(F.floor(C("a") / VAD_FRAME).cast("long"), F.floor((C("z") - 1) / VAD_FRAME).cast("long")))
    rows = rows.select("session_id", "a", "z", frame.alias("frame"))
    lo = F.greatest("a", C("frame") * VAD_FRAME)
    hi = F.least(C("z"), (C("frame") + 1) * VAD_FRAME)
    rows = rows.select("session_id", "frame", lo.alias("lo"), hi.alias("hi")).groupBy("session_id", "frame").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    at = lambda n: F.floor(n * F.lit(step) + 0.5).cast("long")
    return rows.select("session_id", "frame", (C("hi") - C("lo")).alias("valid"),
                       at(C("lo")).alias("start_sample"), (at(C("hi") - 1) + 1).alias("end_sample"))


def label_speech(frames: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Joins model scores (session_id, frame, score); speech is strictly above the threshold."""
    return frames.join(scores, ["session_id", "frame"], "left").withColumn(
        "is_speech", F.coalesce(C("score") > threshold, F.lit(False)))
