"""WARC archives in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with a group of WARC records,
and a skippable frame at its end: the seek table of the seekable format, with every
frame's sizes and a footer that says where the table begins. Beside the bundle stands a
map from record identifiers to frame and offset in the frame, so that one record costs
one frame. Bundles are rows of a table that Spark writes and reads, so that they lie in
any store and a lost task leaves none behind.

Of records with equal payloads the one with the smallest id is a response, the others
are revisits that refer to it and hold no payload.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import common

# Payloads below so many bytes are always stored.
LEAST = 100
# Raw bytes of a frame and of a bundle, beyond which the next begins.
FRAME, BUNDLE = 256 << 10, 8 << 20

# Numbers of the seekable format, and names of the archive format.
SKIPPABLE, FOOTER = 0x184D2A5E, 0x8F92EAB1
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = pa.list_(pa.struct([("page_id", pa.int64()), ("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())]))
BUNDLES = pa.schema([("bundle_id", pa.string()), ("bundle", pa.binary()), ("records", RECORDS)])
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(name: str) -> int | None:
    value = name.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, date: str, size: int) -> bytes:
    """One WARC record; `size` is the payload's, which a revisit does not hold."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)))
    if revisit:
        head += [("WARC-Refers-To", record_id(first)), ("WARC-Profile", PROFILE)]
    block = http if revisit else http + payload
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, of the response in it, and the payload."""
    if not data.startswith(VERSION):
        raise ValueError("not a WARC record")
    head, _, rest = data[len(VERSION) :].partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: compressed and raw size of every frame."""
    entries = b"".join(struct.pack("<II", a, b) for a, b in frames)
    footer = struct.pack("<IBI", len(frames), 0, FOOTER)
    return struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """Begin, compressed size and raw size of every frame, from the bundle's end."""
    count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != FOOTER:
        raise ValueError("the bundle has no seek table")
    width = 12 if descriptor & 0x80 else 8
    table = bundle[-9 - width * count : -9]
    out, begin = [], 0
    for i in range(count):
        packed, raw = struct.unpack_from("<II", table, width * i)
        out.append((begin, packed, raw))
        begin += packed
    return out


def frame(bundle: bytes, number: int) -> bytes:
    """The records of one frame; the others are not touched."""
    begin, packed, raw = frames_of(bundle)[number]
    return zstandard.ZstdDecompressor().decompress(bundle[begin : begin + packed], max_output_size=raw)


class Bundler:
    """Collects records into frames, and frames into a bundle."""

    def __init__(self):
        self.coder = zstandard.ZstdCompressor(level=3)
        self.clear()

    def clear(self):
        self.parts, self.sizes, self.records, self.open, self.length, self.raw = [], [], [], [], 0, 0

    def add(self, page: int | None, data: bytes):
        self.records.append({"page_id": page, "record_id": record_id(page), "frame": len(self.sizes), "offset": self.length, "length": len(data)})
        self.open.append(data)
        self.length += len(data)
        self.raw += len(data)
        if self.length >= FRAME:
            self._close()

    def _close(self):
        if self.open:
            packed = self.coder.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.length))
            self.open, self.length = [], 0

    def finish(self) -> pa.RecordBatch:
        self._close()
        data = b"".join(self.parts) + seek_table(self.sizes)
        out = pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(data).hexdigest()]), pa.array([data], pa.binary()), pa.array([self.records], RECORDS)], schema=BUNDLES)
        self.clear()
        return out


def _bundle(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Bundler()
        for batch in batches:
            for page, url, payload, digest, size, first, revisit in zip(*(batch.column(i).to_pylist() for i in range(7))):
                made.add(page, record(page, url, payload or b"", digest, first, revisit, date, size))
                if made.raw >= BUNDLE:
                    yield made.finish()
        if made.records:
            yield made.finish()

    return run


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archive every row at `path`: bundles, and what each holds.

    The payload is the html in UTF-8; null is empty. Payloads of `LEAST` bytes or more
    that are equal are stored once, in the record with the smallest id (all of them, where
    rows repeat it); rows without an id come last and have the id `none`. `date` is the
    capture date of all records. Other columns are not read.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = common.small_batches(pages).select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    firsts = rows.where(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_n"))
    # A digest seen once needs no answer: only those that repeat are joined.
    firsts = firsts.where("_n > 1").select("digest", "first")
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kept = F.when(~revisit, F.col("payload"))
    out = joined.select("page_id", "url", kept.alias("payload"), "digest", F.col("size").cast("long"), "first", revisit.alias("revisit"))
    bundles = out.mapInArrow(_bundle(date), "bundle_id string, bundle binary, records array<struct<page_id:long,record_id:string,frame:int,offset:int,length:int>>")
    bundles.write.option("compression", "uncompressed").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle, records in zip(batch.column(0), batch.column(1)):
            bundle, rows, held = bundle.as_py(), [], (-1, b"")
            for at in records.as_py():
                if at["frame"] != held[0]:
                    held = at["frame"], frame(bundle, at["frame"])
                fields, http, payload = parse(held[1][at["offset"] : at["offset"] + at["length"]])
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                size = len(payload) if kind == "response" else int(http["Content-Length"])
                refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                rows.append((page_of(fields["WARC-Record-ID"]), size, digest, kind, refers))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)


def read(spark: SparkSession, path: str) -> DataFrame:
    """`page_id`, `payload_bytes`, `payload_digest`, `record_type` and `refers_to` of every record."""
    schema = "bundle_id string, bundle binary, records array<struct<page_id:long,record_id:string,frame:int,offset:int,length:int>>"
    bundles = spark.read.schema(schema).parquet(path)
    return bundles.select("bundle", "records").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for bundle, at in zip(batch.column(0), batch.column(1)):
            at = at.as_py()
            data = frame(bundle.as_py(), at["frame"])[at["offset"] : at["offset"] + at["length"]]
            yield pa.RecordBatch.from_arrays([pa.array([at["page_id"]], pa.int64()), pa.array([data], pa.binary())], names=["page_id", "record"])


def fetch(spark: SparkSession, path: str, pages: list[int]) -> DataFrame:
    """The records of some pages, each from its own frame alone."""
    schema = "bundle binary, records array<struct<page_id:long,record_id:string,frame:int,offset:int,length:int>>"
    held = spark.read.schema(schema).parquet(path)
    found = held.select("bundle", F.explode("records").alias("at")).where(F.col("at.page_id").isin(pages))
    return found.mapInArrow(_fetch, "page_id long, record binary")


ORACLE = """
    WITH rows AS (
        SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
    firsts AS (
        SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload) END AS first FROM rows)
    SELECT page_id, payload_bytes, sha256(payload) AS payload_digest,
           CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM firsts"""
