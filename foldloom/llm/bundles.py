"""Seekable Zstandard bundles of WARC records.

``write`` turns pages into WARC/1.1 records.  Records of one task are grouped into frames of about
``FRAME_BYTES``, each compressed on its own; a bundle ends with a skippable frame that holds the
seek table (compressed size, size and checksum of every frame) and its footer, so any zstd reader
still reads the bundle as one WARC file.  A bundle is one row of a table: its name, its bytes and
the place of each record (frame number, offset in the frame, length).  Spark's writer puts the
table wherever the cluster keeps data and commits it as a whole, so a lost executor leaves no
broken file.  ``read`` decodes all frames by the seek table; ``fetch`` decodes only the frames of
the wanted records.

Payloads of at least ``LEAST`` bytes that occur again are written once: the record with the
smallest page_id is the response, the others are revisits that refer to it.

Defined cases: a null html is an empty payload; a null url writes no target; control characters and
spaces in a url are percent-encoded; a null page_id never is the response of a payload that has
another one; rows that repeat the smallest page_id of a payload are all responses; an empty table
gives no bundle; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldloom.llm.store import Scratch, attach

LEAST = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

# magic numbers of the seekable format, fixed values
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

BUNDLE = "bundle string, content binary, entries array<struct<record_id string, frame int, offset long, length long>>"
RECORD = """record_id string, page_id string, url string, record_type string, refers_to string,
            payload_bytes long, payload_digest string, payload binary"""


def with_references(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest and refers_to: the smallest page_id with the same large payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    facts = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    first = facts.filter(F.octet_length("payload") >= least).groupBy("digest")
    first = first.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    joined = attach(facts, Scratch.kept(first), ["digest"], "n", "left")
    return joined.withColumn("refers_to", F.expr("if(first is null or page_id <=> first, null, first)")).drop("first")


def record_id(page: object) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Frames and seek table of one bundle."""

    def __init__(self, name: str, frame_bytes: int):
        self.name, self.frame_bytes = name, frame_bytes
        self.frames: list[bytes] = []
        self.seek: list[tuple[int, int, int]] = []
        self.entries: list[dict] = []
        self.raw = bytearray()
        self.size = 0

    def add(self, name: str, data: bytes) -> None:
        if self.raw and len(self.raw) + len(data) > self.frame_bytes:
            self._close_frame()
        self.entries.append(
            {"record_id": name, "frame": len(self.frames), "offset": len(self.raw), "length": len(data)}
        )
        self.raw += data
        self.size += len(data)

    def _close_frame(self) -> None:
        raw = bytes(self.raw)
        packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(raw)
        self.frames.append(packed)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.raw.clear()

    def finished(self) -> bytes:
        if self.raw:
            self._close_frame()
        table = b"".join(struct.pack("<III", *s) for s in self.seek)
        footer = struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer


def seek_table(bundle: bytes) -> list[tuple[int, int, int, int]]:
    """Place, compressed size, size and checksum of every frame, from the footer."""
    count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or descriptor != 0x80:
        raise ValueError("the bundle does not end with a seek table")
    start = len(bundle) - 9 - 12 * count
    if struct.unpack("<II", bundle[start - 8 : start]) != (SKIPPABLE, 12 * count + 9):
        raise ValueError("the seek table is not a skippable frame")
    out, at = [], 0
    for packed, size, check in struct.iter_unpack("<III", bundle[start:-9]):
        out.append((at, packed, size, check))
        at += packed
    return out


def frame_of(bundle: bytes, entry: tuple[int, int, int, int]) -> bytes:
    at, packed, size, check = entry
    raw = zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=size)
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError("a frame does not match its checksum")
    return raw


def parsed(frame: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at``, and where the next one starts."""
    end = frame.index(b"\r\n\r\n", at)
    lines = frame[at:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    body = frame.index(b"\r\n\r\n", start) + 4
    http = dict(line.split(": ", 1) for line in frame[start : body - 4].decode().split("\r\n")[1:])
    payload, digest = frame[body:stop], head["WARC-Payload-Digest"].removeprefix("sha256:")
    if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"{head['WARC-Record-ID']} does not match its digest")

    def page(name: str | None) -> str | None:
        return name[len("<urn:x-page:") : -1] or None if name else None

    row = {
        "record_id": head["WARC-Record-ID"],
        "page_id": page(head["WARC-Record-ID"]),
        "url": head.get("WARC-Target-URI"),
        "record_type": head["WARC-Type"],
        "refers_to": page(head.get("WARC-Refers-To")),
        "payload_bytes": int(http["Content-Length"]),
        "payload_digest": digest,
        "payload": payload if head["WARC-Type"] == "response" else None,
    }
    return row, stop + 4


def bundles(
    pages: DataFrame, least: int = LEAST, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """The table of bundles: bundle, content, entries."""
    schema = StructType.fromDDL(BUNDLE)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, number, bundle = context.partitionId() if context else 0, 0, None

        def row(done: BundleWriter) -> pa.RecordBatch:
            values = [[done.name], [done.finished()], [done.entries]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, ARROW_BUNDLE, strict=True)], schema.names
            )

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page, url, payload, digest, refers_to = (c[i].as_py() for c in columns)
                if bundle is None:
                    bundle = BundleWriter(f"bundle-{part:06d}-{number:06d}.warc.zst", frame_bytes)
                bundle.add(record_id(page), record(page, url, payload, digest, refers_to))
                if bundle.size >= bundle_bytes:
                    yield row(bundle)
                    number, bundle = number + 1, None
        if bundle is not None:
            yield row(bundle)

    return with_references(pages, least).mapInArrow(written, schema)


ARROW_BUNDLE = [
    pa.string(),
    pa.binary(),
    pa.list_(
        pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
    ),
]


def write(pages: DataFrame, path: str, **sizes: int) -> None:
    """Write the bundles of all pages to a folder that Spark can write."""
    bundles(pages, **sizes).write.option("compression", "none").parquet(path)


def _rows(found: list[dict], payloads: bool) -> pa.RecordBatch:
    names = [c.split()[0] for c in RECORD.split(",")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
    if not payloads:
        names, kinds = names[:-1], kinds[:-1]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names
    )


def _record_schema(payloads: bool) -> StructType:
    schema = StructType.fromDDL(RECORD)
    return schema if payloads else StructType(schema.fields[:-1])


def read(table: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of a table of bundles; a frame at a time is in memory."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                bundle = content.as_buffer().to_pybytes()
                for entry in seek_table(bundle):
                    frame, at, found = frame_of(bundle, entry), 0, []
                    while at < len(frame):
                        row, at = parsed(frame, at)
                        found.append(row)
                    yield _rows(found, payloads)

    return table.select("content").mapInArrow(decoded, _record_schema(payloads))


def fetch(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted`` (record_id): only their frames are decoded."""
    places = table.select("bundle", F.explode("entries").alias("e")).select("bundle", "e.*")
    places = places.join(wanted.select("record_id").distinct(), "record_id")
    places = places.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, own in zip(batch.column("content"), batch.column("places").to_pylist(), strict=True):
                bundle = content.as_buffer().to_pybytes()
                seek = seek_table(bundle)
                for number in sorted({p["frame"] for p in own}):
                    frame = frame_of(bundle, seek[number])
                    yield _rows([parsed(frame, p["offset"])[0] for p in own if p["frame"] == number], True)

    return table.join(places, "bundle").select("content", "places").mapInArrow(decoded, _record_schema(True))
