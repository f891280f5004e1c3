"""WAV segments: header inventory and decoded sample blocks.

Files are read by byte range: the inventory seeks from chunk to chunk, decoding reads the slices it
wants. No file is loaded whole, so neither the place of the audio nor a length over 2 GiB matters.
Where the bytes come from a table instead of files, a column ``content`` holds them.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
# Fixed values of the format: the 32-bit "see ds64" mark, and the fields at the start of the chunks that are read.
MARK32 = 4_294_967_295
LAYOUT = {
    b"ds64": ("<QQQI", ("ds_riff", "ds_data", "ds_frames", "ds_table")),
    b"fmt ": ("<HHIIHH", ("code", "channels", "rate", "byte_rate", "align", "bits")),
    b"fact": ("<I", ("fact",)),
}
_FIELDS = ("riff32 bigint, rf64 boolean, wave boolean, code int, channels int, rate bigint, byte_rate bigint, align int, bits int, "
           "fact bigint, data32 bigint, data_at bigint, ds_riff bigint, ds_data bigint, ds_frames bigint, ds_table bigint")
_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
#: Blocks of one file that a task decodes in a row.
RUN = 1024


def open_bytes(path: str, content: bytes | None):
    """A seekable reader of a file on any store that Arrow reaches, or of bytes at hand."""
    if content is not None:
        return io.BytesIO(content)
    uri = re.sub("^file:/*(?=/)", "file://", path) if path.startswith("file:") else re.sub("^s3[an]:", "s3:", path)
    store, name = pyarrow.fs.FileSystem.from_uri(uri)
    return store.open_input_file(name)


def chunk_directory(f, length: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, declared size and place of the body of each chunk, the audio last."""
    at = 12
    while at + 8 <= length:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        yield name, size, at + 8
        if name == b"data":
            return
        at += 8 + size + size % 2


def header_fields(f, length: int) -> dict:
    """What the lead and the chunks of LAYOUT say; a chunk too short for its fields says nothing."""
    if length < 12:
        return {"wave": False}
    kind, size, form = struct.unpack("<4sI4s", f.read(12))
    out = {"riff32": size, "rf64": kind == b"RF64", "wave": kind in (b"RIFF", b"RF64") and form == b"WAVE"}
    for name, size, body in chunk_directory(f, length) if out["wave"] else ():
        if name == b"data":
            out |= {"data32": size, "data_at": body}
        elif name in LAYOUT:
            packed, names = LAYOUT[name]
            n = struct.calcsize(packed)
            if size >= n and body + n <= length:
                f.seek(body)
                out |= zip(names, struct.unpack(packed, f.read(n)), strict=True)
    return out


def _headers():
    """Arrow function, made on call because declaring one needs a running session."""
    @F.pandas_udf(_FIELDS)
    def headers(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for paths, lengths, contents in rows:
            found = []
            for path, length, content in zip(paths, lengths, contents, strict=True):
                with open_bytes(path, content) as f:
                    found.append(header_fields(f, length))
            yield pd.DataFrame({n: pd.Series([h.get(n) for h in found], dtype=object) for n in _NAMES})

    return headers


def inventory(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per file (path, length): format, declared and physical frames, exactness.

    ``keep`` passes further columns through, so that decoding needs no join with the files.
    """
    content = C("content") if "content" in files.columns else F.lit(None).cast("binary")
    d = files.select("path", "length", *keep, _headers()("path", "length", content).alias("h")).select("path", "length", *keep, "h.*")
    zero = F.lit(0).cast("long")
    declared = F.when(C("rf64"), C("ds_data")).otherwise(C("data32"))
    payload = F.greatest(zero, C("length") - C("data_at"))
    d = d.withColumn("declared", declared).withColumn("payload", payload)
    d = d.withColumn("matches", (C("payload") == C("declared")) | (C("payload") == C("declared") + C("declared") % 2))
    physical = F.when(C("matches"), C("declared")).otherwise(C("payload"))
    sound = (C("align") == C("channels") * C("bits") / 8) & (C("byte_rate") == C("rate") * C("align")) & (C("channels") > 0) & (C("rate") > 0)
    coded = ((C("code") == 1) & C("bits").isin(16, 24)) | ((C("code") == 3) & (C("bits") == 32))
    d = d.withColumn("format_valid", F.coalesce(sound & coded, F.lit(False)))
    aligned = C("align") > 0
    d = d.withColumn("physical_frames", F.when(aligned, F.floor(physical / C("align"))).otherwise(0).cast("long")).withColumn(
        "trailing_bytes", F.when(aligned, physical % C("align")).otherwise(physical).cast("long")).withColumn(
        "declared_frames", F.when(aligned, F.floor(C("declared") / C("align"))).otherwise(0).cast("long"))
    base = C("matches") & C("format_valid") & (C("trailing_bytes") == 0)
    riff = ~C("rf64") & (C("riff32") != MARK32) & (C("riff32") + 8 == C("length")) & ((C("code") != 3) | (C("fact") == C("physical_frames")))
    rf64 = (C("rf64") & (C("riff32") == MARK32) & (C("data32") == MARK32) & (C("ds_riff") + 8 == C("length")) & (C("ds_frames") == C("physical_frames"))
            & (C("ds_table") == 0) & (C("payload") - C("declared") == C("declared") % 2) & ((C("code") != 3) | (C("fact") == MARK32)))
    error = (F.when(C("length") < 12, "too_short").when(~C("wave"), "not_wave").when(C("code").isNull() | C("data_at").isNull(), "no_format_or_data")
             .when(C("rf64") & C("ds_data").isNull(), "no_ds64"))
    ok = error.isNull()
    sane = lambda c, n: F.when(ok, c).alias(n)
    return d.select(
        "path", "length", *keep, error.alias("error"), sane(F.when(C("rf64"), "rf64").otherwise("riff"), "container"), sane(C("rate"), "sample_rate"),
        sane(C("channels"), "channels"), sane(C("bits"), "bit_depth"), sane(F.when(C("code") == 1, "pcm").when(C("code") == 3, "float"), "encoding"),
        sane(C("format_valid"), "format_valid"), sane(C("data_at"), "data_at"), sane(C("declared_frames"), "declared_frames"),
        sane(C("physical_frames"), "physical_frames"), sane(C("trailing_bytes"), "trailing_bytes"), sane(F.coalesce(base & (riff | rf64), F.lit(False)), "exact_header"))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path and length of the files below ``root``; their bytes stay where they are."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
    return f.select("path", "length")


def _decode(raw: bytes, bits: int) -> np.ndarray:
    """PCM bytes of whole frames to float32 within [-1, 1); 32-bit samples are floats."""
    if bits == 16:
        return np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(32768)
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / np.float32(8388608)
    return np.frombuffer(raw, "<f4")


def pcm_blocks(files: DataFrame, frames_per_block: int) -> DataFrame:
    """Sample blocks of mono files (path, data_at, bit_depth, physical_frames).

    Runs of RUN blocks are dealt over the tasks, so a long file is decoded in many places; a task reads
    one block's bytes at a time.
    """
    held = "content" in files.columns
    width = F.floor(C("bit_depth") / 8).cast("int")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((C("physical_frames") - 1) / frames_per_block).cast("long"))
    rows = files.where("physical_frames > 0").select("path", *(["content"] if held else []), "data_at", "bit_depth", "physical_frames", F.explode(blocks).alias("block"))
    start = C("block") * frames_per_block
    n = F.least(F.lit(frames_per_block).cast("long"), C("physical_frames") - start)
    at, size = C("data_at") + start * width, n * width
    raw = F.substring("content", (at + 1).cast("int"), size.cast("int")) if held else F.lit(None).cast("binary")
    rows = rows.select("path", start.alias("block_start"), (start + n).alias("block_end"), C("bit_depth").cast("int").alias("bit_depth"), at.alias("at"), size.alias("size"), raw.alias("raw"))
    if not held:
        run = F.floor(C("block_start") / (frames_per_block * RUN))
        rows = rows.repartition("path", run).sortWithinPartitions("path", "block_start")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, f = None, None
        for p in batches:
            samples = []
            for path, at, size, bits, raw in zip(p["path"], p["at"], p["size"], p["bit_depth"], p["raw"], strict=True):
                if raw is None:
                    if path != name:
                        name, f = path, open_bytes(path, None)
                    f.seek(at)
                    raw = f.read(size)
                samples.append(_decode(bytes(raw), bits))
            p["samples"] = samples
            yield p[["path", "block_start", "block_end", "samples"]]

    return rows.mapInPandas(decode, "path string, block_start long, block_end long, samples array<float>")
