"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records, closed by a skippable frame with the
seek table of the public seekable format. The index maps a record to its bundle, frame, and offset and length within
the frame, so one record is read by decompressing one frame. Bundles are .warc.zst files in the shared folder, which
any reader of Zstandard files can open; the table of bundles names them and holds their index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bitmap, col, cut, shared_dir, small_batches

SEEKABLE_MAGIC = 0x8F92EAB1
SKIPPABLE_MAGIC = 0x184D2A5E
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 24

#: Payloads that most rows share, whose responses are broadcast; and tasks that read archives, at most.
MOST_SHARED, MOST_READERS = 1024, 20_000

BUNDLES = "bundle string, path string, bytes long, records array<struct<record_id: string, frame: int, offset: bigint, length: bigint>>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, uri: str, date: str, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record; with refers_to a revisit, whose block is the HTTP head with the full payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = head if refers_to else head + payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's headers (lower-case names), the payload length of its HTTP head, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields | {"payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload": payload}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: compressed and plain size of each. Descriptor 0: no checksums."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frames_of(archive) -> list[tuple[int, int, int]]:
    """Start, compressed size and plain size of every frame, from the seek table at the end of a file object (or of bytes)."""
    f = pa.BufferReader(archive) if isinstance(archive, bytes) else archive
    size = f.seek(0, 2)
    f.seek(max(0, size - 9))
    n, descriptor, magic = struct.unpack("<IBI", f.read(9).rjust(9, b"\0"))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the archive")
    entry = 12 if descriptor & 0x80 else 8
    f.seek(size - 9 - n * entry)
    table, out, at = f.read(n * entry), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(archive, frame: tuple[int, int, int]) -> bytes:
    f = pa.BufferReader(archive) if isinstance(archive, bytes) else archive
    f.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(f.read(frame[1]), max_output_size=frame[2])


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path that a place in the shared folder is on."""
    try:
        return fs.FileSystem.from_uri(path)
    except pa.ArrowException as e:
        raise ValueError(f"archives can't be written to {path}: {e}") from e


class Bundler:
    """Writes records to a bundle's file, frame by frame. Its name is its own, so a task that is run again leaves the bundle
    of its first run beside, which no table names. The file takes its name when it is whole."""

    def __init__(self, folder: str, level: int, frame_bytes: int, bundle_bytes: int):
        self.fs, self.folder = place_of(folder)
        self.at, self.zstd, self.frame_bytes, self.bundle_bytes = folder, zstandard.ZstdCompressor(level=level), frame_bytes, bundle_bytes
        self.out = None
        self.clear()

    def clear(self) -> None:
        self.sizes, self.index, self.open, self.held, self.total = [], [], [], 0, 0

    def add(self, record_id: str, raw: bytes) -> None:
        if self.out is None:
            self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            self.fs.create_dir(self.folder, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.folder}/.{self.name}", compression=None)
        self.index.append({"record_id": record_id, "frame": len(self.sizes), "offset": self.held, "length": len(raw)})
        self.open.append(raw)
        self.held += len(raw)
        if self.held >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.out.write(frame)
            self.sizes.append((len(frame), self.held))
            self.total += len(frame)
            self.open, self.held = [], 0

    def full(self) -> bool:
        return self.total >= self.bundle_bytes

    def finish(self) -> dict:
        self.close_frame()
        table = seek_table(self.sizes)
        self.out.write(table)
        self.out.close()
        self.out = None
        self.fs.move(f"{self.folder}/.{self.name}", f"{self.folder}/{self.name}")
        row = {"bundle": self.name, "path": f"{self.at}/{self.name}", "bytes": self.total + len(table), "records": self.index}
        self.clear()
        return row


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0, level: int = 3, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, folder: str | None = None) -> DataFrame:
    """Write a record per row into .warc.zst files in folder (by default one of its own in the shared folder) and return
    the table of bundles (columns as in BUNDLES).

    Of rows with equal payloads of at least min_revisit_bytes, the one with the largest id is a response and the
    others revisit it; a null payload is empty. Null ids lose against others and revisit them; rows that repeat the
    largest id are all responses. Control characters and spaces in a url are percent-encoded, a null url is empty.
    A payload is held whole by the task that writes it. An empty table gives no bundles. Other columns are ignored.

    Only ids and digests are shuffled, and the payloads of rare repeated pages: pages that occur once are kept in place by
    a bitmap of the repeated digests, and the responses of the most repeated ones are broadcast.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/signalstudy/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
    place_of(folder)
    payload = F.coalesce(col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    shared = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    shared = cut(shared, "warc-shared")
    top = cut(shared.orderBy(F.desc("n"), "digest").limit(MOST_SHARED).drop("n"), "warc-most-shared")
    rare = shared.join(F.broadcast(top.select("digest")), "digest", "left_anti").select("digest", F.col("first_id").alias("rare_id"))
    sure, unsure = by_bitmap(rows.join(F.broadcast(top), "digest", "left"), ["digest"], rare.select("digest"))
    first = F.coalesce("first_id", "rare_id")
    rows = sure.withColumn("rare_id", F.lit(None).cast(rare.schema["rare_id"].dataType)).unionByName(unsure.join(rare, "digest", "left"))
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(first), first).cast("string").alias("refers_to"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Bundler(folder, level, frame_bytes, bundle_bytes)
        for batch in batches:
            for row in batch.to_pylist():
                rid = f"urn:x-page:{row['id'] if row['id'] is not None else ''}"
                digest = base64.b32encode(row["digest"]).decode()
                b.add(rid, record(rid, _uri(row["url"]), date, row["payload"], digest, f"urn:x-page:{row['refers_to']}" if row["refers_to"] is not None else None))
                if b.full():
                    yield pa.RecordBatch.from_pylist([b.finish()], schema=schema)
        if b.index:
            yield pa.RecordBatch.from_pylist([b.finish()], schema=schema)

    struct_ = pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("bundle", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("records", pa.list_(struct_))])
    return cut(rows.mapInArrow(bundle, BUNDLES), "warc-bundles")


def record_index(bundles: DataFrame) -> DataFrame:
    """record_id, path, frame, offset and length of every record."""
    return bundles.select("path", F.explode("records").alias("r")).select("r.record_id", "path", "r.frame", "r.offset", "r.length")


def read_archives(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives, read from their files through seek tables and index: record_id, bundle, record_type,
    uri, payload_bytes long, payload_digest and refers_to (record id, null for responses), and the payload if asked for.
    One frame is held at a time. A response whose payload doesn't match its digest or length raises. No bundles give no
    rows.
    """
    names = ["record_id", "bundle", "record_type", "uri", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_payload
    schema = pa.schema(list(zip(names, kinds)))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                files, path = place_of(row["path"])
                found, archive = [], files.open_input_file(path)
                frames, plain, at = frames_of(archive), b"", -1
                for r in row["records"]:
                    if r["frame"] != at:
                        at = r["frame"]
                        plain = read_frame(archive, frames[at])
                    x = parse(plain[r["offset"] : r["offset"] + r["length"]])
                    digest = x["warc-payload-digest"].removeprefix("sha1:")
                    if x["warc-type"] == "response" and (len(x["payload"]) != x["payload_bytes"] or base32_sha1(x["payload"]) != digest):
                        raise ValueError(f"damaged record {x['warc-record-id']} in {row['bundle']}")
                    to = x.get("warc-refers-to")
                    found.append((x["warc-record-id"][1:-1], row["bundle"], x["warc-type"], x["warc-target-uri"], x["payload_bytes"], digest, to and to[1:-1]) + ((x["payload"],) if with_payload else ()))
                    if len(found) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], schema=schema)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], schema=schema)

    sql = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in names)
    tasks = max(1, min(bundles.count(), MOST_READERS))
    return bundles.select("bundle", "path", "records").repartition(tasks).mapInArrow(read, sql)


def read_record(path: str, frame: int, offset: int, length: int) -> dict:
    """One record by its place in the index: only its frame is read and decompressed."""
    files, path = place_of(path)
    with files.open_input_file(path) as archive:
        return parse(read_frame(archive, frames_of(archive)[frame])[offset : offset + length])
