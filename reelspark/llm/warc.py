"""WARC records as a chunked record table.

An archive is a table of (record_no, chunk_no, n_chunks, data) rows; the data of its rows in that order is a
WARC 1.1 stream. Headers and payloads are cut into chunks by Spark, so an oversized payload is many bounded
rows and never one allocation of a Python worker. The reader takes chunks one by one and carries the length
and the SHA-1 digest of the payload from chunk to chunk.

Null html counts as the empty payload, a null url gives an empty target, rows with a null page_id are records
of their own that others never refer to. Rows that are repeated with their page_id are all the response.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CHUNK = 64 << 10
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def base32(hex_digest: Column) -> Column:
    """Base 32 of a SHA-1 digest in hexadecimal: five hex digits are four base-32 digits."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row a page with payload, digest, record_type and refers_to.

    Of pages with equal payloads of at least `least_bytes`, the one with the smallest page_id is the
    response. Payloads meet by digest: counts are combined before the shuffle and Spark may split the
    join of a frequent payload.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    first = (base.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha1", "first"))
    repeat = F.col("first").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("first"))
    return base.join(first, "sha1", "left").select(
        "page_id", "url", "payload", "payload_bytes", base32(F.col("sha1")).alias("payload_digest"),
        F.when(repeat, "revisit").otherwise("response").alias("record_type"), F.when(repeat, F.col("first")).alias("refers_to"))


def write_records(records: DataFrame, date: str = "1970-01-01T00:00:00Z", chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of `plan_records`: WARC header, HTTP header and, for a response, the payload."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    length = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target), F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length.cast("string")), F.lit("\r\n"))
    whole = records.withColumn("http", http).withColumn("front", F.encode(F.concat(head, F.col("http")), "UTF-8"))
    whole = whole.withColumn("n_front", F.expr(f"cast((octet_length(front) - 1) div {CHUNK} as int)"))  # chunks before the one in which the header ends
    whole = whole.withColumn("n_chunks", F.col("n_front") + F.when(revisit, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk))).cast("int"))
    # Numbered before they are cut: beside explode() in one select, the number would be that of a chunk.
    rows = whole.withColumn("record_no", F.monotonically_increasing_id()).select(
        "record_no", "n_chunks", "n_front", "front", F.when(~revisit, F.col("payload")).alias("payload"),
        F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    none = F.encode(F.lit(""), "UTF-8")
    front = F.when(F.col("chunk_no") <= F.col("n_front"), F.expr(f"substring(front, chunk_no * {CHUNK} + 1, {CHUNK})")).otherwise(none)
    part = F.when(F.col("chunk_no") >= F.col("n_front"), F.coalesce(F.expr(f"substring(payload, (chunk_no - n_front) * {chunk} + 1, {chunk})"), none)).otherwise(none)
    data = F.concat(front, part, F.when(F.col("chunk_no") == F.col("n_chunks") - 1, F.encode(F.lit("\r\n\r\n"), "UTF-8")).otherwise(none))
    return rows.select("record_no", "chunk_no", "n_chunks", data.alias("data"))


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


class Record:
    """A record whose chunks arrive in order; holds its header, a length and a running digest."""

    def __init__(self, chunk: memoryview):
        self.raw, self.head = bytearray(), None
        self.add(chunk)

    def begin(self, chunk: memoryview) -> memoryview:
        """Collects both headers; returns what of the chunk follows them."""
        old = len(self.raw)
        self.raw += chunk
        if not self.raw.startswith(b"WARC/1."[: len(self.raw)]):
            raise ValueError("a chunk that begins a record has no WARC header")
        ends = self.raw.find(b"\r\n\r\n") + 4
        starts = self.raw.find(b"\r\n\r\n", ends) + 4
        if ends < 4 or starts < 4:
            return chunk[:0]
        self.head, self.http = _fields(bytes(self.raw[: ends - 4])), _fields(bytes(self.raw[ends : starts - 4]))
        self.left = int(self.head["content-length"]) - (starts - ends)
        self.size, self.digest, self.raw = 0, hashlib.sha1(usedforsecurity=False), bytearray()
        return chunk[starts - old :]

    def add(self, chunk: memoryview) -> None:
        if self.head is None:
            chunk = self.begin(chunk)
            if self.head is None:
                return
        part = chunk[: self.left]
        self.digest.update(part)
        self.left -= len(part)
        self.size += len(part)

    def row(self) -> tuple:
        if self.head is None:
            raise ValueError("a record ends within its header")
        kind, told = self.head["warc-type"], self.head["warc-payload-digest"].removeprefix("sha1:")
        got = base64.b32encode(self.digest.digest()).decode()
        intact = self.left == 0 and (kind == "revisit" or got == told)
        size = int(self.http["content-length"]) if kind == "revisit" else self.size
        return _page(self.head["warc-record-id"]), size, told if kind == "revisit" else got, kind, _page(self.head.get("warc-refers-to")), intact


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    record, out, due = None, [], None
    for batch in batches:
        data = batch.column(batch.schema.get_field_index("data"))
        order = zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("record_no", "chunk_no", "n_chunks")), strict=True)
        for i, (of_record, no, of) in enumerate(order):
            chunk = memoryview(data[i].as_buffer())
            if (due or (of_record, 0)) != (of_record, no):
                raise ValueError(f"chunk {no} of record {of_record} comes out of turn")
            due = (of_record, no + 1) if no < of - 1 else None
            if no == 0:
                record = Record(chunk)
            else:
                record.add(chunk)
            if no == of - 1:
                out.append(record.row())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if due:
        raise ValueError(f"record {due[0]} ends before chunk {due[1]}")


def read_records(archive: DataFrame) -> DataFrame:
    """One row a record of a chunk table. `intact`: the payload has the length and the digest of its header.

    Records of one chunk are read where they lie; only the chunks of longer ones are brought together.
    """
    short = archive.where("n_chunks = 1").mapInArrow(_read, FIELDS)
    long = archive.where("n_chunks > 1").repartition("record_no").sortWithinPartitions("record_no", "chunk_no").mapInArrow(_read, FIELDS)
    return short.unionAll(long)


def oracle() -> str:
    """What the archive says of each page, straight from the pages, in DuckDB SQL."""
    groups = " || ".join(
        f"list_aggregate(list_transform([15, 10, 5, 0], lambda k: substr('{BASE32}', ((('0x' || substr(h, {5 * i + 1}, 5))::bigint >> k) & 31)::int + 1, 1)), 'string_agg', '')" for i in range(8))
    return f"""
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
f as (select *, min(page_id) over (partition by html) first from p)
select page_id, strlen(html) payload_bytes, {groups} payload_digest, case when page_id > first then 'revisit' else 'response' end record_type,
       case when page_id > first then first end refers_to from f"""
