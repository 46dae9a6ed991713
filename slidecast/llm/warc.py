"""WARC archives in seekable Zstandard bundles.

Pages become WARC/1.1 records. Records are grouped into Zstandard frames that
decompress on their own, frames into bundles, and each bundle ends with the
seek table of the seekable format (a skippable frame with each frame's
compressed and decompressed size). An index table maps a record identifier to
(bundle, frame, offset in the decompressed frame, length), so one record is
read by decompressing one frame.

Payload digests are SHA-1 in bare upper-case base32. Of records with equal
payloads the one with the smallest id is a ``response``; others become
``revisit`` records that keep digest, HTTP head (with the payload's length)
and a reference, but no payload. Payloads below ``min_revisit_bytes`` are
always responses. Equality is decided on (SHA-256, SHA-1, length).

Bundles are rows of a Parquet table (id, content), written by Spark's own
committer: a lost executor's bundles are written again, never twice. Bundles
are closed at ``BUNDLE_BYTES``, frames at ``FRAME_BYTES``, so memory is
bounded by one bundle (or one record, if that is larger).
:func:`bundle_file` is the content as a file that any WARC reader opens.

Edge cases: a null payload is empty; null ids come after all numbers; records
that share the smallest id of their payload are all responses; a null URL is
written as ``urn:none``; an empty table gives an empty archive; other columns
are ignored. Line breaks in URLs are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidecast.session import scratch_path

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1

_BUNDLE_SCHEMA = "kind string, bundle string, content binary, page_id {id}, record_id string, frame int, frame_offset long, length long"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "urn:none").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    body = http if is_revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, bytes, bytes, int]:
    """(WARC headers, HTTP head, payload, end) of the record at an offset."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = end + 4
    stop = start + int(headers["Content-Length"])
    split = raw.index(b"\r\n\r\n", start, stop) + 4
    return headers, raw[start:split], raw[split:stop], stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Footer: a skippable frame with (compressed, decompressed) sizes."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    body = entries + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(compressed offset, compressed size, decompressed size) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEK_MAGIC:
        raise ValueError("no seek table")
    table = content[len(content) - 9 - 8 * n : len(content) - 9]
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", table):
        out.append((at, c, d))
        at += c
    return out


def read_frame(content: bytes, frame: int) -> bytes:
    """One frame, decompressed on its own."""
    at, c, d = read_seek_table(content)[frame]
    return zstandard.ZstdDecompressor().decompress(content[at : at + c], max_output_size=d)


def _writer(id_type: pa.DataType, frame_bytes: int, bundle_bytes: int):
    schema = pa.schema([
        ("kind", pa.string()), ("bundle", pa.string()), ("content", pa.binary()), ("page_id", id_type),
        ("record_id", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        frames: list[tuple[int, int]] = []
        content, frame, places = bytearray(), bytearray(), []

        def close_frame():
            if frame:
                packed = compressor.compress(bytes(frame))
                frames.append((len(packed), len(frame)))
                content.extend(packed)
                frame.clear()

        def close_bundle():
            close_frame()
            if not frames:
                return
            whole = bytes(content) + seek_table(frames)
            name = hashlib.sha256(whole).hexdigest()[:32]  # by content: a repeated task names it alike
            n = len(places)
            rows = {
                "kind": ["bundle"] + ["record"] * n, "bundle": [name] * (n + 1), "content": [whole] + [None] * n,
                "page_id": [None] + [p[0] for p in places], "record_id": [None] + [_record_id(p[0]) for p in places],
                "frame": [None] + [p[1] for p in places], "frame_offset": [None] + [p[2] for p in places],
                "length": [None] + [p[3] for p in places]}
            frames.clear()
            content.clear()
            places.clear()
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to, is_revisit = (batch.column(c)[i].as_py() for c in range(5))
                payload = html.encode("utf-8", "surrogatepass") if html is not None else b""
                record = build_record(page_id, url, payload, refers_to, is_revisit)
                places.append((page_id, len(frames), len(frame), len(record)))
                frame.extend(record)
                if len(frame) >= frame_bytes:
                    close_frame()
                if len(content) >= bundle_bytes:
                    yield from close_bundle()
        yield from close_bundle()

    return write


def _reader(id_type: pa.DataType):
    number = pa.types.is_integer(id_type)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                content = value.as_py()
                for frame in range(len(read_seek_table(content))):
                    raw, at, rows = read_frame(content, frame), 0, []
                    while at < len(raw):
                        headers, http, payload, at = parse_record(raw, at)
                        kind = headers["WARC-Type"]
                        told = dict(x.split(": ", 1) for x in http.decode().strip().split("\r\n")[1:])
                        length = int(told["Content-Length"])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                        to = lambda x: None if not x else int(x) if number else x
                        rows.append((to(headers["X-Page-ID"]), length, digest, kind, to(headers.get("X-Refers-To-Page", ""))))
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                         pa.array(cols[3], pa.string()), pa.array(cols[4], id_type)],
                        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return read


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_revisit_bytes: int = 0) -> DataFrame:
    """Pages with their record type: page_id, url, html, refers_to, is_revisit."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(payload_col).cast("string").alias("html"))
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = F.concat(F.unhex(F.sha2(raw, 256)), F.unhex(F.sha1(raw)), F.octet_length(raw).cast("string").cast("binary"))
    first = (
        rows.filter(F.octet_length(raw) >= min_revisit_bytes).select(key.alias("key"), "page_id")
        .groupBy("key").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    # Few payloads repeat: the join keeps every page's payload on its own side, split where a payload is hot.
    return rows.withColumn("key", key).join(first.hint("shuffle_hash"), "key", "left").select(
        "page_id", "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"),
        (F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("is_revisit"))


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES) -> None:
    """Write pages as bundles and their index under ``path`` (kind=bundle, kind=record)."""
    planned = plan_records(pages, id_col, url_col, payload_col, min_revisit_bytes)
    id_field = planned.schema["page_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    planned.mapInArrow(
        _writer(to_arrow_type(id_field), frame_bytes, bundle_bytes),
        _BUNDLE_SCHEMA.format(id=id_field.simpleString()),
    ).write.partitionBy("kind").option("compression", "uncompressed").option(
        "parquet.block.size", str(16 << 20)).parquet(path)


def _rows(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """Both kinds; a filter on the kind reads its folder only."""
    return spark.read.schema(_BUNDLE_SCHEMA.format(id=id_type)).parquet(path)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """The bundles: (bundle, content)."""
    return _rows(spark, path, "bigint").filter("kind = 'bundle'").select("bundle", "content")


def record_index(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """The index: (page_id, record_id, bundle, frame, frame_offset, length)."""
    return _rows(spark, path, id_type).filter("kind = 'record'").select(
        "page_id", "record_id", "bundle", "frame", "frame_offset", "length")


def read_bundles(spark: SparkSession, path: str, id_type=None) -> DataFrame:
    """Every record read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import LongType

    id_type = id_type or LongType()
    name = id_type.simpleString()
    return bundles(spark, path).select("content").mapInArrow(
        _reader(to_arrow_type(id_type)),
        f"page_id {name}, payload_bytes long, payload_digest string, record_type string, refers_to {name}")


def read_record(content: bytes, frame: int, frame_offset: int) -> tuple[dict, bytes]:
    """(headers, payload) of one record, by the index, decompressing one frame."""
    headers, _, payload, _ = parse_record(read_frame(content, frame), frame_offset)
    return headers, payload


def bundle_file(content: bytes, path: str) -> None:
    """Write a bundle as a .warc.zst file."""
    with open(path, "wb") as f:
        f.write(content)


def archive_roundtrip(pages: DataFrame, **names) -> DataFrame:
    """Write ``pages`` to bundles in the shared work folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_bundles(pages, path, **names)
    return read_bundles(spark, path, pages.schema[names.get("id_col", "page_id")].dataType)
