"""WARC archives as a chunked record table.

Writing: each task streams its records into one gzip-member-per-record archive in a shared folder; a payload passes through the digest, the
compressor and the file in slices. A file's name holds the task attempt, and only files that a committed manifest row names
are read, so a lost executor leaves at most files that nobody reads.

Reading: each archive is streamed; a record becomes rows of (record_id, chunk_no) with at most `chunk_bytes` of payload each, the bytes so
far and the SHA-1 so far, so no record is ever held whole. The last chunk's digest is the record's.

Roles: of pages with equal payloads of at least `least` bytes, the one with the largest page id is the response and others revisit
it. Digests, not payloads, are grouped; payloads move once, by the unique page id.

Defined results: a null html is the empty payload, a response; rows equal in page id and payload share one role (all response where
that id is the largest); pages without id revisit one with an id if there is one, else all are responses; an empty table
gives no archive and an empty result; columns besides page id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BUSY, in_batches, join_busy, materialize, scratch, table

LEAST, CHUNK, SLICE = 1000, 1 << 16, 1 << 16
CHUNKS = "record_id string, page_id string, target_uri string, record_type string, refers_to string, chunk_no int, data binary, bytes_so_far long, sha1_so_far string, is_last boolean, payload_bytes long, payload_digest string"


def roles(pages: DataFrame, least: int = LEAST, busy: int = BUSY) -> DataFrame:
    """page_id, digest, payload_bytes, refers_to (null for responses) for each distinct page id and payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    meta = materialize(pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes")).distinct(), "digests")
    largest = meta.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1")
    out = join_busy(meta, largest, "digest", largest.where(F.col("n") >= busy).select("digest"))
    return out.select("page_id", "digest", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes one archive a task under folder (any URI that pyarrow.fs opens) and returns the manifest: file, records.

    records: page_id, url, html, digest, payload_bytes, refers_to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        ctx, out, n = TaskContext.get(), None, 0
        name = f"part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}.warc.gz"
        try:
            for b in batches:
                for i in range(b.num_rows):
                    page, url, html, digest, size, refers = (b.column(c)[i].as_py() if c != "html" else b.column(c)[i] for c in ("page_id", "url", "html", "digest", "payload_bytes", "refers_to"))
                    if out is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    revisit = refers is not None
                    data = memoryview(b"") if revisit or not html.is_valid else memoryview(html.as_buffer())
                    clean = (url or "").replace("\r", " ").replace("\n", " ")
                    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:sightline:{digest}:{page}>", f"WARC-Target-URI: {clean}", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(data)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
                    head += [f"X-Page-ID: {page}"] * (page is not None) + ([f"WARC-Refers-To: <urn:sightline:{digest}:{refers}>", f"X-Refers-To-Page-ID: {refers}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else [])
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(z.compress("\r\n".join([*head, "", ""]).encode()))
                    for k in range(0, len(data), SLICE):
                        out.write(z.compress(data[k : k + SLICE]))
                    out.write(z.compress(b"\r\n\r\n") + z.flush())
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=["file", "records"])

    return in_batches(records.select("page_id", "url", "html", "digest", "payload_bytes", "refers_to"), run, "file string, records long")


class Source:
    """Decompressed bytes of an archive of gzip members (or of plain bytes), at most a slice at a time however well they were compressed."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.raw, self.z, self.plain = stream, bytearray(), 0, b"", None, None

    def more(self) -> bool:
        """Some bytes more; False at the end."""
        while True:
            if self.z is not None and self.z.eof:
                self.raw, self.z = self.z.unused_data, None
            elif self.z is not None and self.z.unconsumed_tail:
                self.raw = self.z.unconsumed_tail
            self.raw = self.raw or self.stream.read(SLICE)
            if not self.raw:
                if self.z is not None and not self.z.eof:
                    raise ValueError("the archive ends within a record")
                return False
            if self.plain is None:
                self.plain = self.raw[:2] != b"\x1f\x8b"
            if self.plain:
                data, self.raw = self.raw, b""
            else:
                self.z = self.z or zlib.decompressobj(31)
                data, self.raw = self.z.decompress(self.raw, SLICE), b""
            if data:
                if self.at > SLICE:
                    del self.held[: self.at]
                    self.at = 0
                self.held += data
                return True

    def line(self) -> bytes | None:
        seen = self.at
        while (i := self.held.find(b"\n", seen)) < 0:
            done = len(self.held) - self.at
            if not self.more():
                return None
            seen = self.at + done
        out, self.at = bytes(self.held[self.at : i]), i + 1
        return out.rstrip(b"\r")

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.more():
            pass
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out


def chunks_of(stream, chunk_bytes: int = CHUNK, with_data: bool = True) -> Iterator[tuple]:
    """Rows of CHUNKS of one archive, as they come."""
    src = Source(stream)
    while True:
        line = src.line()
        while line == b"":
            line = src.line()
        if line is None:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = {}
        while line := src.line():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.lower()] = v.strip()
        left, sofar, sha, no = int(head["content-length"]), 0, hashlib.sha1(), 0
        while True:
            data = src.read(min(chunk_bytes, left))
            if len(data) < min(chunk_bytes, left):
                raise ValueError("the archive ends within a record")
            left -= len(data)
            sofar += len(data)
            sha.update(data)
            kind = head.get("warc-type")
            said = head.get("warc-payload-digest", "").removeprefix("sha1:")
            if not left and kind == "response" and said and said not in (sha.hexdigest(), base64.b32encode(sha.digest()).decode()):
                raise ValueError(f"record {head.get('warc-record-id')} has another payload than its header's digest says")
            # A revisit has no payload of its own: length and digest of the full payload are in its header.
            full = (int(head.get("x-payload-length", 0)), head.get("warc-payload-digest", "").removeprefix("sha1:")) if kind == "revisit" else (sofar, sha.hexdigest())
            yield (head.get("warc-record-id"), head.get("x-page-id"), head.get("warc-target-uri"), kind, head.get("x-refers-to-page-id"), no, data if with_data else None, sofar, sha.hexdigest(), not left, *(full if not left else (None, None)))
            no += 1
            if not left:
                break


def chunk_table(manifest: DataFrame, chunk_bytes: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The record table of the archives that the manifest names; a file is one task's work."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for file in b.column("file").to_pylist():
                store, path = fs.FileSystem.from_uri(file)
                with store.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for r in chunks_of(stream, chunk_bytes, with_data):
                        rows.append(r)
                        size += len(r[6] or b"") + 200
                        if size > 8_000_000:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    names = [x.split()[0] for x in CHUNKS.split(", ")]
    files = manifest.select("file")
    n = max(1, manifest.count())
    return files.repartition(n, "file").mapInArrow(run, CHUNKS)


def archive(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the pages' archives and returns their manifest."""
    r = roles(pages, least)
    # Skew: payloads move by page id and digest, so copies of one payload are spread; the digest's own join in `roles` carries no payloads.
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").alias("id_"), "url", "html", F.sha1(payload).alias("digest_"))
    records = p.join(r, p["id_"].eqNullSafe(r["page_id"]) & (p["digest_"] == r["digest"]))
    return materialize(write(records, folder), "manifest")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archive(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    rows = chunk_table(manifest).where("is_last")
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(CAST(encode(coalesce(html, '')) AS BLOB)) AS BIGINT) AS payload_bytes FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN response IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM r
"""
