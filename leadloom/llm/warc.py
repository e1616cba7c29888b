"""ZIP-packaged web archives: written per task, read by range without extraction.

An archive is a ZIP file with stored (uncompressed) members: the WARC data,
in which each record is a gzip member of its own, and an index with the place
of every record. The reader parses the end record, the ZIP64 records and the
central directory, finds the data's first byte, and reads single records by
range. Files go through Arrow's file systems, so any store that these reach
(local, HDFS, S3, GCS) will do.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from leadloom.llm.common import text_or_empty, width
from leadloom.session import scratch_path, write_scratch

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# --- records --------------------------------------------------------------------

def record(page_id, kind: str, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record as a gzip member; a revisit carries the HTTP head only, whose length is the full payload's."""
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    if kind == "response":
        block += payload
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    target = " ".join((url or "").split())
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
             f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: {name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def parse_record(data: bytes) -> dict:
    """Fields and payload of one record (a whole gzip member); the payload of a revisit is None."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": _fields(http), "payload": payload if fields["warc-type"] == "response" else None}


def _page_of(name: str | None) -> int | None:
    digits = (name or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


# --- the ZIP container ------------------------------------------------------------

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def directory(read_at, size: int) -> dict[str, Member]:
    """Members of a ZIP file, from its central directory (ZIP64 where needed). ``read_at(at, n)`` gives n bytes."""
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP file")
    count, length, at = struct.unpack("<HII", tail[end + 10:end + 20])
    locator = end - 20
    if locator >= 0 and tail[locator:locator + 4] == b"PK\x06\x07":
        at64 = struct.unpack("<Q", tail[locator + 8:locator + 16])[0]
        end64 = read_at(at64, 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("broken ZIP64 end record")
        count, length, at = struct.unpack("<QQQ", end64[32:56])
    entries, pos, found = read_at(at, length), 0, {}
    for _ in range(count):
        if entries[pos:pos + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method = struct.unpack("<H", entries[pos + 10:pos + 12])[0]
        packed, full = struct.unpack("<II", entries[pos + 20:pos + 28])
        n, m, k = struct.unpack("<HHH", entries[pos + 28:pos + 34])
        header_at = struct.unpack("<I", entries[pos + 42:pos + 46])[0]
        name = entries[pos + 46:pos + 46 + n].decode("utf-8")
        extra, e = entries[pos + 46 + n:pos + 46 + n + m], 0
        while e + 4 <= len(extra):
            tag, used = struct.unpack("<HH", extra[e:e + 4])
            if tag == 1:
                values = iter(struct.unpack(f"<{used // 8}Q", extra[e + 4:e + 4 + used // 8 * 8]))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header_at = next(values) if header_at == 0xFFFFFFFF else header_at
            e += 4 + used
        found[name] = Member(name, method, packed, header_at)
        pos += 46 + n + m + k
    return found


def data_start(read_at, member: Member) -> int:
    """First byte of a stored member; its local header may hold other extra fields than the directory."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = read_at(member.header_at, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    n, m = struct.unpack("<HH", head[26:30])
    return member.header_at + 30 + n + m


class ArchiveWriter:
    """One archive; ``close`` returns (uri, bytes, records)."""

    def __init__(self, uri: str, zip64: bool = False):
        fs, path = _open(uri)
        self.uri, self.stream, self.at, self.index = uri, fs.open_output_stream(path), 0, []
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.zip64 = zip64
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, page_id, kind, url, payload, digest, refers_to) -> None:
        packed = record(page_id, kind, url, payload, digest, refers_to)
        self.index.append(json.dumps({"page_id": page_id, "type": kind, "offset": self.at, "length": len(packed)}))
        self.data.write(packed)
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=self.zip64) as out:
            for line in self.index:
                out.write(line.encode() + b"\n")
        self.zip.close()
        self.stream.close()
        return self.uri, self.at, len(self.index)


class ArchiveReader:
    def __init__(self, uri: str):
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        self.read_at = lambda at, n: self.file.read_at(n, at)
        self.members = directory(self.read_at, self.file.size())
        self.data_at = data_start(self.read_at, self.members[DATA])

    def entries(self) -> Iterator[dict]:
        member = self.members[INDEX]
        start = data_start(self.read_at, member)
        with io.BufferedReader(_Range(self.read_at, start, member.size), 1 << 20) as lines:
            for line in lines:
                yield json.loads(line)

    def record(self, offset: int, length: int) -> dict:
        return parse_record(self.read_at(self.data_at + offset, length))

    def close(self) -> None:
        self.file.close()


class _Range(io.RawIOBase):
    def __init__(self, read_at, start: int, size: int):
        self.read_at, self.at, self.end = read_at, start, start + size

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.read_at(self.at, min(len(buffer), self.end - self.at))
        buffer[:len(data)] = data
        self.at += len(data)
        return len(data)


# --- Spark --------------------------------------------------------------------------

def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 least_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, digest, kind, refers_to): which rows are stored and which refer to an equal payload.

    Of equal payloads of at least ``least_bytes`` bytes, rows with the smallest
    id are responses, the others revisits. Only digests and ids are
    aggregated; the smallest id per digest comes with map-side combine.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.encode(text_or_empty(F.col(html_col)), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    # Only payloads that repeat are looked up; the other rows' digests match nothing.
    joined = rows.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"),
                         F.when(again, F.col("first")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str, max_bytes: int = 64 << 20) -> DataFrame:
    """Write archives of about ``max_bytes`` of records below ``folder``; returns (uri, bytes, records).

    Each attempt writes names of its own, and only files in the returned list
    count, so a repeated task does no harm. The list is written at once.
    """
    schema = pa.schema([("uri", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])

    def run(batches):
        writer, done = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if writer is None:
                        writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                    writer.add(r["page_id"], r["kind"], r["url"], r["payload"], r["digest"], r["refers_to"])
                    if writer.at >= max_bytes:
                        done.append(writer.close())
                        writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)

    return write_scratch(planned.mapInArrow(run, "uri string, bytes bigint, records bigint"), "archives")


def list_records(archives: DataFrame) -> DataFrame:
    """(uri, page_id, type, offset, length) of every record, from the archives' indexes."""
    schema = pa.schema([("uri", pa.string()), ("page_id", pa.int64()), ("type", pa.string()), ("offset", pa.int64()),
                        ("length", pa.int64())])

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                reader, rows = ArchiveReader(uri), []
                for e in reader.entries():
                    rows.append({"uri": uri, **e})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                reader.close()
                yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("uri").repartition(width(archives.sparkSession), "uri").mapInArrow(
        run, "uri string, page_id bigint, type string, offset bigint, length bigint")


def read_records(listed: DataFrame, run_bytes: int = 16 << 20) -> DataFrame:
    """(page_id, url, type, digest, payload_bytes, refers_to, payload) of the listed records, by range reads.

    Runs of about ``run_bytes`` of one archive go to one task; payload is null for a revisit.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        reader, uri = None, None
        for batch in batches:
            rows, size = [], 0
            for r in batch.to_pylist():
                if r["uri"] != uri:
                    if reader:
                        reader.close()
                    reader, uri = ArchiveReader(r["uri"]), r["uri"]
                got = reader.record(r["offset"], r["length"])
                f, payload = got["fields"], got["payload"]
                rows.append({"page_id": _page_of(f["warc-record-id"]), "url": f["warc-target-uri"], "type": f["warc-type"],
                             "digest": f["warc-payload-digest"].partition(":")[2],
                             "payload_bytes": int(got["http"]["content-length"]),
                             "refers_to": _page_of(f.get("warc-refers-to")), "payload": payload})
                size += len(payload or b"")
                if size > 8 << 20 or len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        if reader:
            reader.close()

    dealt = listed.repartition(width(listed.sparkSession), "uri", F.floor(F.col("offset") / run_bytes))
    return dealt.sortWithinPartitions("uri", "offset").mapInArrow(
        run, "page_id bigint, url string, type string, digest string, payload_bytes bigint, refers_to bigint, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """Write ``pages`` to archives and read every record back.

    Null html is an empty payload; a null id stays null and is never referred
    to; repeated rows get a record each; an empty table gives an empty table.
    """
    archives = write_archives(plan_records(pages, **names), folder or _folder(spark))
    return read_records(list_records(archives))


def _folder(spark: SparkSession) -> str:
    from pyarrow import fs

    path = scratch_path(spark, "warc")
    store, inner = _open(path)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(inner, recursive=True)
    return path


def digest_of(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()
