"""Web archives: a WARC writer with a compression dictionary for each archive, and its reader.

Every task writes archives of its own into the shared folder. A Zstandard dictionary is built from the
first records of an archive and stands in a skippable frame at its head, every record is one frame
compressed with it. Equal payloads are stored once: the page with the smallest identifier is the
response, the others are revisits of it. Which files count is told by the table that the write
returns, so files of lost tasks are never read.

Defined results: a null page is an empty payload; a null url is left out; rows that share the smallest
identifier of a payload are all responses; a null identifier is the largest; an empty table has no
archives; extra columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Saved, pick, scratch

_FRAME = 0x184D2A5D.to_bytes(4, "little")  # the skippable frame that holds the dictionary
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "tabwise/pages")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, records long, bytes long"
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("refers_to", T.LongType()),
])


def first_of_payload(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with refers_to: the smallest page_id of the payload, where that is another page.

    Only digests and identifiers are grouped; a payload with many copies is summed before the shuffle.
    """
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")), 256)
    large = F.octet_length(F.coalesce(F.col("html"), F.lit(""))) >= least_bytes
    slim = pages.filter(large).select("page_id", digest.alias("digest"))
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = slim.join(first, "digest").filter("first is not null and not (page_id <=> first)").distinct()
    keyed = pages.withColumn("digest", F.when(large, digest))
    return keyed.alias("p").join(
        revisits.alias("r"), F.expr("p.page_id <=> r.page_id and p.digest = r.digest"), "left"
    ).select("p.page_id", "p.url", "p.html", F.col("r.first").alias("refers_to"))


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, str(page_id))}>"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    headers = [("WARC-Record-ID", _name(page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{_digest(payload)}")]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)))
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    headers.append(("Content-Type", "application/http;msgtype=response"))
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _record("response", headers, status + payload)
    headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _record("revisit", headers, status)


class _Archive:
    """One archive: the first records are held back until the dictionary is built from them."""

    def __init__(self, fs: pafs.FileSystem, path: str, date: str, dictionary_bytes: int, sample_bytes: int):
        self.out, self.path = fs.open_output_stream(path, compression=None), path
        self.dictionary_bytes, self.sample_bytes = dictionary_bytes, sample_bytes
        self.held: list[bytes] = [_record("warcinfo", [("WARC-Record-ID", _name(None)), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")]
        self.held_bytes, self.records, self.bytes, self.press = 0, 0, 0, None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.press is not None:
            self.write(self.press.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= self.sample_bytes:
            self.begin()

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def begin(self) -> None:
        dictionary = None
        try:  # too few or too plain records give no dictionary; the archive then has none
            dictionary = zstd.train_dictionary(self.dictionary_bytes, [x[:65536] for x in self.held])
        except zstd.ZstdError:
            pass
        if dictionary is not None:
            body = dictionary.as_bytes()
            self.write(_FRAME + len(body).to_bytes(4, "little") + body)
        self.press = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for x in self.held:
            self.write(self.press.compress(x))
        self.held = []

    def close(self) -> tuple[str, int, int]:
        if self.press is None:
            self.begin()
        self.out.close()
        return self.path, self.records, self.bytes


def write_archives(spark: SparkSession, pages: DataFrame, folder: str | None = None, least_bytes: int = 0, archive_bytes: int = 64 << 20, dictionary_bytes: int = 64 << 10, sample_bytes: int = 4 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row (page_id, url, html) and return the archives (path, records, bytes).

    folder: any that pyarrow's file systems and all executors reach; a new shared one by default.
    """
    folder = folder or scratch(spark)
    if "://" not in folder and ":/" not in folder:
        folder = f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task, now, made = TaskContext.get(), None, []
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(i) for i in range(4)), strict=True):
                if now is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/pages-{task.partitionId():05d}-{task.taskAttemptId()}-{len(made):04d}.warc.zst"
                    now = _Archive(fs, path, date, dictionary_bytes, sample_bytes)
                payload = (html.as_py() or "").encode()
                now.add(page_record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), date))
                if now.bytes >= archive_bytes:
                    made.append(now.close())
                    now = None
        if now is not None:
            made.append(now.close())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["path", "records", "bytes"])

    known = first_of_payload(pick(pages, "page_id", "url", "html"), least_bytes)
    files = known.mapInArrow(run, FILES).withColumn("path", F.concat(F.lit(folder + "/"), F.element_at(F.split("path", "/"), -1)))
    return Saved(spark)(files)


def _frames(stream, press: zstd.ZstdDecompressor, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of each frame, one after the other."""
    data = stream.read(chunk)
    while data:
        parts, frame = [], press.decompressobj()
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                break
            if not (data := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)
        data = frame.unused_data or stream.read(chunk)


def read_archive(stream) -> Iterator[tuple]:
    """Records of an open archive: (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    dictionary, head = None, stream.read(8)
    if head[:4] == _FRAME:
        dictionary = zstd.ZstdCompressionDict(stream.read(int.from_bytes(head[4:], "little")))
    else:
        stream.seek(0)
    for record in _frames(stream, zstd.ZstdDecompressor(dict_data=dictionary)):
        head, _, rest = record.partition(b"\r\n\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n"))}
        kind = headers["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        status, _, payload = rest[: int(headers["content-length"])].partition(b"\r\n\r\n")
        size = int(status.rpartition(b"Content-Length: ")[2])
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != size or _digest(payload) != digest):
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
        page_id, refers_to = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
        yield page_id and int(page_id), size, digest, kind, refers_to and int(refers_to)


def read_archives(files: DataFrame) -> DataFrame:
    """The records of the archives listed in (path, …); each is read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                rows: list[tuple] = []
                with fs.open_input_file(path) as stream:
                    for row in read_archive(stream):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORDS.names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=RECORDS.names)

    return files.select("path").repartition(max(1, files.count()), "path").mapInArrow(run, RECORDS)


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, upper(sha1(html)) as h, min(page_id) over (partition by html) as first from p)
select page_id, payload_bytes::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 8 * 2 + i % 8 // 4), 5))::bigint // (32 ** (3 - i % 4))::bigint) % 32)::integer, 1)), '') as payload_digest,
  case when page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from d
"""
