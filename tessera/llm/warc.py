"""WARC archives with an embedded Zstandard dictionary.

A task writes its records to archives of its own: it gathers the first records
(at most SAMPLE_BYTES), trains a dictionary on them, writes it in a leading
skippable frame, and compresses every record as a frame of its own with it.
Readers find the dictionary at the start and can then decompress any frame.

Of records with equal payloads (at least min_revisit bytes) the one with the
smallest id is the response, the others are revisits of it without payload.
Which one that is comes from an aggregation by digest, before anything is
written; the payloads themselves are dealt out by id, so a group of copies
does not meet in one task.

An archive goes to a name that no other attempt uses; the name is returned as
a row, so an archive of a lost or repeated attempt is never read.

Defined results
- null payloads are empty, and count as payloads of 0 bytes.
- an id that repeats: its rows are separate records; rows that are equal in id
  and payload to the response are responses too. Null ids count as the
  largest; equal payloads of which all ids are null are all responses.
- a payload of any length is one record; empty tables write no archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut, fresh_path, ship

SKIPPABLE = 0x184D2A5D
SAMPLE_BYTES, DICT_BYTES, LEVEL = 1_500_000, 48_000, 3
ROLL_BYTES = 256_000_000  # of payload in one archive
DATE = "1970-01-01T00:00:00Z"  # archives of equal input are equal
WROTE = "path string, n_records long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string"


def open_for(path: str, mode: str):
    """A file of a folder that all executors share; for stores beyond the file system, pyarrow's."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(url.path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if "w" in mode else store.open_input_stream(inner)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, uri: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its digest and length are those of what it revisits."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in uri))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Payload-Length: {size}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    n = int(fields["content-length"])
    if rest[n : n + 4] != b"\r\n\r\n" or len(rest) != n + 4:
        raise ValueError("record length")
    return fields, rest[:n]


class Archive:
    """Writes records; the first ones wait until the dictionary can be trained."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.waiting: list[bytes] = []
        self.waiting_bytes = self.bytes = self.n = 0
        self.out = None

    def add(self, raw: bytes) -> None:
        self.n += 1
        self.bytes += len(raw)
        if self.out is None:
            self.waiting.append(raw)
            self.waiting_bytes += len(raw)
            if self.waiting_bytes >= SAMPLE_BYTES:
                self._start()
        else:
            self.out.write(self.compress.compress(raw))

    def _start(self) -> None:
        self.out = open_for(self.path, "wb")
        try:
            made = zstandard.train_dictionary(DICT_BYTES, [r[:100_000] for r in self.waiting], k=200, d=8)
        except zstandard.ZstdError:  # too few or too small records for one
            made = zstandard.ZstdCompressionDict(b"", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = made.as_bytes()
        packed = zstandard.ZstdCompressor(level=9).compress(raw)
        self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, **({"dict_data": made} if raw else {}))
        for r in self.waiting:
            self.out.write(self.compress.compress(r))
        self.waiting = []

    def close(self) -> tuple[str, int]:
        if self.out is None:
            self._start()
        self.out.close()
        return self.path, self.n


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one frame after the other."""
    with open_for(path, "rb") as f:
        magic, n = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError("no dictionary frame")
        raw = zstandard.ZstdDecompressor().decompress(f.read(n))
        make = lambda: zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {})).decompressobj()
        rest = b""
        while block := rest or f.read(1 << 20):
            frame, parts = make(), []
            while True:
                parts.append(frame.decompress(block))
                if frame.eof:
                    break
                if not (block := f.read(1 << 20)):
                    raise ValueError("the archive ends inside a record")
            rest = frame.unused_data
            yield parse(b"".join(parts))


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    archive, done = None, []
    for batch in batches:
        ids, uris, texts, refs = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            payload, refers = (texts[i].as_py() or "").encode(), refs[i].as_py()
            if archive is None:
                archive = Archive(folder)
            body = payload if refers is None else b""
            archive.add(record(ids[i].as_py(), uris[i].as_py(), body, digest_of(payload), len(payload), refers))
            if archive.bytes >= ROLL_BYTES:
                done.append(archive.close())
                archive = None
    if archive is not None:
        done.append(archive.close())
    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "n_records"])


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Writes the archives; a row for each: path, n_records."""
    spark = df.sparkSession
    ship(spark)
    local = urlparse(folder)
    if local.scheme in ("", "file"):
        os.makedirs(local.path, exist_ok=True)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(text_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    groups = (
        rows.filter(F.octet_length("payload") >= min_revisit)
        .groupBy("sha")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1 and first is not null")
    )
    # narrow: which (id, digest) revisits which id. The payloads are then dealt out by id, not by digest
    marks = rows.select("id", "sha").join(groups.drop("copies"), "sha").filter("not (id <=> first)").distinct()
    marks = marks.select(F.col("id").alias("m_id"), F.col("sha").alias("m_sha"), "first")
    joined = rows.join(marks, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("sha") == F.col("m_sha")), "left")
    return joined.select("id", "uri", "payload", "first").mapInArrow(lambda it: _write(folder, it), WROTE)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x else None
    names = [c.split(" ")[0] for c in READ.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            out = []
            for fields, payload in read_archive(path):
                revisit = fields["warc-type"] == "revisit"
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and digest != digest_of(payload):
                    raise ValueError(f"{path}: the digest of {fields['warc-record-id']} is another")
                size = int(fields["x-payload-length"]) if revisit else len(payload)
                own, other = (fields.get(k, "")[len("<urn:page:") : -1] for k in ("warc-record-id", "warc-refers-to"))
                out.append((number(own), size, digest, fields["warc-type"], number(other), fields.get("warc-target-uri"), path))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of the archives in column path."""
    ship(archives.sparkSession)
    return archives.select("path").mapInArrow(_read, READ)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    written = cut(write_archives(pages, fresh_path(spark, "warc")))  # once; only archives whose task ended are read
    return read_archives(written).drop("archive")
