"""WARC records in seekable Zstandard bundles, written and read back by Spark tasks.

Records of a bundle are grouped into frames that decompress on their own. A bundle ends
with a skippable frame that holds the seek table: for each frame its compressed and
decompressed size, then the number of frames and the magic number. An index, itself a
table, maps each record to its bundle, frame, offset inside the decompressed frame and
length, so one record is read with three ranged reads: footer, seek table, frame.

Which record is a response: the payload digests are grouped natively, the smallest page
id of a digest is the response and the others revisit it (a third of all pages may share
one payload: the grouping is pre-aggregated and only ids and digests are joined).

Bundles are written by the tasks through pyarrow's file systems, each under the name of
its task attempt and renamed when whole. The index holds the rows of the attempts that
counted, so what a lost executor leaves behind is never read. Bundles are read by Spark's
binary file source.

Choices: a null payload is empty. Rows that repeat the smallest page id of a payload are
all responses. A null page id sorts last; its record has an empty id. A null url leaves
out the target header. Payloads below ``min_bytes`` are all responses. An empty table
writes no bundle. Columns other than these are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tauframe.llm.storage import bound_batches, checkpoint, shared_folder

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = "<IBI"
ENTRY = "<II"
FOOTER_SIZE, ENTRY_SIZE = struct.calcsize(FOOTER), struct.calcsize(ENTRY)
#: Records of one date: the archive is the same whenever it is written.
RECORD_DATE = "2000-01-01T00:00:00Z"

INDEX_SCHEMA = "page_id long, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def _record(page_id, url, payload: bytes, length: int, digest: str, refers_to, kind: str) -> bytes:
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>",
        f"WARC-Date: {RECORD_DATE}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {length}"]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers_to}')}>",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


class BundleWriter:
    """Bundles of one task: records go to a frame, full frames to the file."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int, level: int, name: str):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.name, self.number, self.out = name, 0, None

    def _open(self) -> None:
        self.bundle = f"{self.name}-{self.number:05d}.warc.zst"
        self.number += 1
        self.part = f"{self.folder}/.{self.bundle}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.part)
        self.written, self.frames, self.frame, self.fill = 0, [], [], 0

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        if self.out is None:
            self._open()
        place = (self.bundle, len(self.frames), self.fill, len(record))
        self.frame.append(record)
        self.fill += len(record)
        if self.fill >= self.frame_bytes:
            self._end_frame()
            if self.written >= self.bundle_bytes:
                self.close()
        return place

    def _end_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.frame))
        self.out.write(packed)
        self.frames.append((len(packed), self.fill))
        self.written += len(packed)
        self.frame, self.fill = [], 0

    def close(self) -> None:
        if self.out is None:
            return
        if self.frame:
            self._end_frame()
        table = b"".join(struct.pack(ENTRY, *x) for x in self.frames)
        footer = struct.pack(FOOTER, len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
        self.out.close()
        self.system.move(self.part, f"{self.folder}/{self.bundle}")
        self.out = None


def seek_table(read, size: int) -> list[tuple[int, int, int]]:
    """(position, compressed size, size) of each frame; ``read(at, n)`` gives bytes."""
    count, flags, magic = struct.unpack(FOOTER, read(size - FOOTER_SIZE, FOOTER_SIZE))
    if magic != SEEKABLE_MAGIC or flags & 0x7F:
        raise ValueError("no seek table")
    raw = read(size - FOOTER_SIZE - count * ENTRY_SIZE, count * ENTRY_SIZE)
    frames, at = [], 0
    for packed, plain in struct.iter_unpack(ENTRY, raw):
        frames.append((at, packed, plain))
        at += packed
    return frames


def read_record(folder: str, bundle: str, frame: int, offset: int, length: int) -> bytes:
    """One record, by ranged reads of the footer, the seek table and its frame."""
    system, path = fs.FileSystem.from_uri(f"{folder}/{bundle}")
    with system.open_input_file(path) as source:
        def read(at: int, n: int) -> bytes:
            source.seek(at)
            return source.read(n)

        at, packed, _ = seek_table(read, source.size())[frame]
        plain = zstandard.ZstdDecompressor().decompress(read(at, packed))
    return plain[offset : offset + length]


def classify_pages(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of each row; refers_to is null for responses."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    keys = checkpoint(pages.select(
        F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("_key"), F.octet_length(payload).alias("_n")))
    groups = keys.filter(F.col("_n") >= min_bytes).groupBy("_key").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return keys.join(groups, "_key").filter(revisit).select(
        "page_id", "_key", F.col("first").alias("refers_to")).distinct()


def write_bundles(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
    frame_bytes: int = 256 << 10,
    bundle_bytes: int = 16 << 20,
    level: int = 3,
) -> DataFrame:
    """Write all records below ``folder``; the index as a frame (``INDEX_SCHEMA``)."""
    spark = pages.sparkSession
    bound_batches(spark)
    revisits = classify_pages(pages, id_col, payload_col, min_bytes)
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("_key"))
    # Revisits alone are looked up; a page id with several payloads has several keys.
    found = revisits.toDF("_page", "_found", "refers_to")
    rows = rows.join(
        found, rows["page_id"].eqNullSafe(found["_page"]) & (rows["_key"] == found["_found"]), "left"
    ).select("page_id", "url", "payload", "refers_to")
    target, _ = fs.FileSystem.from_uri(folder)
    target.create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer = BundleWriter(folder, frame_bytes, bundle_bytes, level, name)
        for batch in batches:
            found = []
            for page_id, url, body, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                kind = "response" if refers is None else "revisit"
                block = body if refers is None else b""
                found.append((page_id, *writer.add(_record(page_id, url, block, len(body), digest, refers, kind))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                names=["page_id", "bundle", "frame", "offset", "length"]) if found else _empty_index()
        writer.close()

    return checkpoint(rows.mapInArrow(write, INDEX_SCHEMA))


def _empty_index() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([], t) for t in (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())],
        names=["page_id", "bundle", "frame", "offset", "length"])


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Every indexed record, read from the bundles (``RECORD_SCHEMA``).

    A response's length and digest are computed anew from the payload that was read and
    must agree with its headers; a revisit has those of the payload it stands for.
    """
    bundles = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("bundle"), "content")
    entries = index.groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset", "length")).alias("entries"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column("content")[i].as_py()
                frames = seek_table(lambda at, n, c=content: c[at : at + n], len(content))
                plain, held, rows = b"", -1, []
                for e in sorted(batch.column("entries")[i].as_py(), key=lambda e: (e["frame"], e["offset"])):
                    if e["frame"] != held:
                        held = e["frame"]
                        at, packed, _ = frames[held]
                        plain = unpack.decompress(content[at : at + packed])
                    rows.append(_fields(plain[e["offset"] : e["offset"] + e["length"]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.join(entries, "bundle").mapInArrow(read, RECORD_SCHEMA)


def _fields(record: bytes) -> tuple:
    headers, block = parse_record(record)
    digest, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["WARC-Payload-Length"])
    if headers["WARC-Type"] == "response":
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest or len(block) != length:
            raise ValueError(f"record of page {headers['WARC-Page-ID']} is damaged")
    number = lambda x: int(x) if x else None
    return (
        number(headers["WARC-Page-ID"]), length, digest, headers["WARC-Type"],
        number(headers.get("WARC-Refers-To-Page-ID")))


def archive_folder(spark: SparkSession) -> str:
    folder = shared_folder(spark, "warc")
    return folder if "://" in folder else "file://" + os.path.abspath(folder)
