"""WARC archives as seekable Zstandard bundles.

Records fill independent Zstandard frames of about ``FRAME_BYTES``; a bundle of about ``BUNDLE_BYTES`` ends with
the seek table of the Zstandard seekable format (a skippable frame that any decoder passes over). An index maps
each record identifier to its frame and its offset inside that frame, so that one record costs one frame.

An archive is a table of bundles (bundle, content, index) and a table of their index sorted by record
identifier, both written and committed by Spark, so it can lie in any store Spark reaches and a lost executor
leaves no half-written file. A lookup is pushed down into the index, then into the bundles by their name.
``export`` puts the same bundles into a mounted folder as .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.common import map_batches, remove, shared_dir, stored

FRAME_BYTES, BUNDLE_BYTES, LEVEL, MIN_REVISIT = 1 << 18, 4 << 20, 3, 0
#: Fixed values of the Zstandard seekable format and of WARC/1.1.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
BUNDLES = "bundle string, content binary, index array<struct<record_id: string, frame: int, offset: long, length: long>>"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit holds the HTTP head only, whose Content-Length is the full payload's."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """(WARC fields, HTTP fields, payload, end) of the record that starts at ``at``."""

    def fields(head: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])

    top = data.index(b"\r\n\r\n", at)
    own = fields(data[at:top])
    end = top + 4 + int(own["Content-Length"])
    http = data.index(b"\r\n\r\n", top + 4)
    return own, fields(data[top + 4 : http]), data[http + 4 : end], end + 4


class Bundle:
    """Collects records into frames; ``close`` gives the bytes with their seek table."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.zstd = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames, self.sizes, self.index, self.open, self.open_bytes, self.bytes = [], [], [], [], 0, 0

    def add(self, name: str, data: bytes) -> None:
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": self.open_bytes, "length": len(data)})
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if self.open:
            packed = self.zstd.compress(b"".join(self.open))
            self.frames.append(packed)
            self.sizes.append((len(packed), self.open_bytes))
            self.bytes += len(packed)
            self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        self._frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(start, packed bytes, plain bytes) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    out, start = [], 0
    for k in range(n):
        at = len(content) - 9 - width * (n - k)
        packed, plain = struct.unpack("<II", content[at : at + 8])
        out.append((start, packed, plain))
        start += packed
    return out


def frame(content: bytes, k: int) -> bytes:
    start, packed, plain = seek_table(content)[k]
    return zstandard.ZstdDecompressor().decompress(content[start : start + packed], max_output_size=max(plain, 1))


class Archive(NamedTuple):
    bundles: DataFrame  # (bundle, content, index)
    index: DataFrame  # (record_id, bundle, frame, offset, length)


def opened(spark: SparkSession, path: str) -> Archive:
    return Archive(spark.read.parquet(f"{path}/bundles"), spark.read.parquet(f"{path}/index"))


def fetch(archive: Archive, page_id: int | None) -> list[bytes]:
    """The records of one page: index rows by identifier, then of each bundle named there one frame."""
    out = []
    for hit in archive.index.where(F.col("record_id") == record_id(page_id)).toLocalIterator():
        content = bytes(archive.bundles.where(F.col("bundle") == hit.bundle).select("content").first().content)
        out.append(frame(content, hit.frame)[hit.offset : hit.offset + hit.length])
    return out


def _pack(frame_bytes: int, bundle_bytes: int, level: int):
    kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, bundle = TaskContext.get().partitionId(), 0, Bundle(frame_bytes, level)

        def done() -> pa.RecordBatch:
            index = bundle.index
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{made:05d}"]), pa.array([bundle.close()], pa.binary()), pa.array([index], kind)], ["bundle", "content", "index"])

        for b in batches:
            names = ("page_id", "url", "html", "keep", "revisit")
            for page, url, html, keep, revisit in zip(*(b.column(c).to_pylist() for c in names)):
                bundle.add(record_id(page), record(page, url, (html or "").encode(), keep, revisit))
                if bundle.bytes >= bundle_bytes:
                    yield done()
                    made, bundle = made + 1, Bundle(frame_bytes, level)
        if bundle.index:
            yield done()

    return run


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> Archive:
    """Write one record per row of ``pages`` (page_id, url, html, ...) to the archive at ``path`` and return it.

    Of equal payloads of at least ``min_revisit`` bytes the largest page_id is the response and the others
    revisit it; shorter payloads are all responses. Null html is an empty payload; null page_ids come before
    all others; rows that repeat the largest page_id with the same payload are responses too. A very long
    payload has a frame and, beyond ``bundle_bytes``, a bundle to itself, which must fit a cell of Spark (2 GB).
    An empty table gives an empty archive; other columns take no part, whatever their names.
    """
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.sha1(F.encode("html", "UTF-8"))
    pages = pages.withColumn("key", F.when(F.octet_length("html") >= min_revisit, key))
    groups = pages.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1").drop("n")
    # stored: its size is known, so the payloads are shuffled only where groups are many; a join of plain tables can split a payload that most pages share
    groups = stored(groups, f"{path}/groups")
    marked = pages.join(groups, "key", "left").select("page_id", "url", "html", "keep", (F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))).alias("revisit"))
    bundles = map_batches(marked, _pack(frame_bytes, bundle_bytes, level), BUNDLES)
    packed = bundles.write.option("compression", "uncompressed").option("parquet.block.size", 2 * bundle_bytes)  # frames are packed already
    packed.mode("overwrite").parquet(f"{path}/bundles")
    remove(pages.sparkSession, f"{path}/groups")
    index = pages.sparkSession.read.schema(BUNDLES).parquet(f"{path}/bundles").select("bundle", F.explode("index").alias("i"))
    index = index.select("i.record_id", "bundle", "i.frame", "i.offset", "i.length").repartitionByRange("record_id").sortWithinPartitions("record_id")
    index.write.option("parquet.block.size", 8 << 20).mode("overwrite").parquet(f"{path}/index")
    return opened(pages.sparkSession, path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda name: None if name is None or name.endswith(":null>") else int(name[len("<urn:page:") : -1])
    for b in batches:
        for content in b.column("content").to_pylist():
            for k in range(len(seek_table(content))):
                data, at, out = frame(content, k), 0, []
                while at < len(data):
                    own, http, payload, at = parse(data, at)
                    kind, said = own["WARC-Type"], own["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (digest(payload) != said or len(payload) != int(http["Content-Length"])):
                        raise ValueError(f"{own['WARC-Record-ID']}: payload differs from its digest")
                    out.append((number(own["WARC-Record-ID"]), int(http["Content-Length"]), said, kind, number(own.get("WARC-Refers-To"))))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read(archive: Archive) -> DataFrame:
    """One row per record of an archive; the payload of every response is checked against its digest."""
    return map_batches(archive.bundles.select("content"), _unpack, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", 4)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    spark: SparkSession = pages.sparkSession
    return read(write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"))


def export(archive: Archive, folder: str) -> None:
    """Put every bundle into a folder that all executors have mounted, each by an atomic rename."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            own = os.path.join(folder, f".{r.bundle}.{uuid.uuid4().hex}")
            with open(own, "wb") as f:
                f.write(r.content)
            os.replace(own, os.path.join(folder, f"{r.bundle}.warc.zst"))

    archive.bundles.select("bundle", "content").foreachPartition(put)
