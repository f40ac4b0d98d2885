"""WARC records in ZIP archives: writer, and a reader by range without extraction.

An archive is a ZIP file (ZIP64 where needed) whose members are stored: WARC
files of one gzip member per record, and an index with the place of each record.
The reader parses the end record, the ZIP64 locator and the central directory,
reads the index members, and fetches runs of records by range; nothing is
unpacked to disk, and no archive is read whole into memory.

Archives lie in a folder that all executors share.  A task names its archives
anew at every attempt and returns their names, so that only archives of attempts
that Spark accepted are in the table of archives.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import prepare, scratch_path, staged
from rankwell.session import read_table

#: Payloads under this many bytes are never revisits.
MIN_REVISIT = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(-?\d+|none)>")


# ---------------------------------------------------------------- records
def _id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(value: str | None) -> int | None:
    m = _ID.fullmatch(value or "")
    return int(m[1]) if m and m[1] != "none" else None


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record with an HTTP head; a revisit has the head only, which still states the payload's length."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _fields(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse_record(data: bytes) -> dict:
    """The parts of one WARC record; the payload's digest is checked for responses."""
    if not data.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload digest does not match in {fields['warc-record-id']}")
    size = len(payload) if kind == "response" else int(_fields(http)["content-length"])
    return {"page_id": _page_id(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload": payload if kind == "response" else None,
            "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _page_id(fields.get("warc-refers-to"))}


# ---------------------------------------------------------------- files
def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (a local path without scheme too)."""
    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class ArchiveWriter:
    """One archive, written from front to back: records go to stored WARC members, the index comes last."""

    def __init__(self, folder: str, member_bytes: int):
        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        fs, path = open_uri(folder)
        fs.create_dir(path, recursive=True)
        fs, path = open_uri(self.uri)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member_bytes, self.member, self.no, self.at = member_bytes, None, 0, 0
        self.index: list[str] = []
        self.bytes = 0

    def _stored(self, name: str):
        return self.zip.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True)

    def add(self, data: bytes) -> None:
        if self.member is None:
            self.name = f"archive/data-{self.no:05d}.warc.gz"
            self.member, self.at = self._stored(self.name), 0
        packed = gzip.compress(data, 1, mtime=0)
        self.member.write(packed)
        self.index.append(json.dumps({"member": self.name, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)
        self.bytes += len(packed)
        if self.at >= self.member_bytes:
            self.member.close()
            self.member, self.no = None, self.no + 1

    def close(self) -> tuple[str, int, int]:
        if self.member is not None:
            self.member.close()
        with self._stored("indexes/index.jsonl") as f:
            f.write("\n".join(self.index).encode())
        self.zip.close()
        self.out.close()
        return self.uri, len(self.index), self.bytes


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 256 << 20, member_bytes: int = 64 << 20, archive_records: int = 100_000, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of (page_id, url, html); returns the table of archives (uri, records, bytes).

    Of rows with equal payloads of at least ``MIN_REVISIT`` bytes the smallest
    page_id is a response (each row that has it, should it repeat), the others
    revisit it.  A null html is an empty payload; a null page_id is larger than
    any other, and rows without one among themselves are all responses.  The
    groups of copies are counted on digests alone, with partial aggregation.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    repeated = rows.where(F.col("size") >= MIN_REVISIT).groupBy(F.col("digest").alias("r_digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = staged(repeated.select("r_digest", "first"), "warc-repeated")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    planned = rows.join(repeated, F.col("digest") == F.col("r_digest"), "left").select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            for page_id, url, payload, digest, size, refers_to in zip(*(batch.column(i) for i in range(6))):
                writer = writer or ArchiveWriter(folder, member_bytes)
                writer.add(record(page_id.as_py(), url.as_py(), payload.as_py(), size.as_py(), digest.as_py(), refers_to.as_py(), date))
                if writer.bytes >= archive_bytes or len(writer.index) >= archive_records:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["uri", "records", "bytes"])

    return staged(planned.mapInArrow(run, "uri string, records long, bytes long"), "warc-archives")


# ---------------------------------------------------------------- reading
@dataclass
class Member:
    """An entry of the central directory."""

    name: str
    method: int
    packed: int
    size: int
    header: int


class ZipDirectory:
    """Directory of a ZIP archive in a file with read_at(n, offset) and size()."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = {m.name: m for m in self._entries()}

    def _entries(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - 65535)
        tail = self.file.read_at(self.size - tail_at, tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP archive")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":  # ZIP64 locator
            end64 = struct.unpack_from("<Q", tail, at - 12)[0]
            record64 = self.file.read_at(56, end64)
            if record64[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end record")
            n, length, start = struct.unpack_from("<QQQ", record64, 32)
        directory = self.file.read_at(length, start)
        at = 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                tag, width = struct.unpack_from("<HH", extra, e)
                if tag == 1:  # ZIP64: only the fields that overflow, in this order
                    f = e + 4
                    if size == 0xFFFFFFFF:
                        size, f = struct.unpack_from("<Q", extra, f)[0], f + 8
                    if packed == 0xFFFFFFFF:
                        packed, f = struct.unpack_from("<Q", extra, f)[0], f + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", extra, f)[0]
                e += 4 + width
            yield Member(name, method, packed, size, header)
            at += 46 + n_name + n_extra + n_comment

    def place(self, name: str) -> tuple[int, int]:
        """(offset, length) of a stored member's bytes in the archive."""
        m = self.members[name]
        if m.method != 0:
            raise ValueError(f"{name} is compressed, not stored")
        local = self.file.read_at(30, m.header)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"damaged local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return m.header + 30 + n_name + n_extra, m.packed

    def records(self, window: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """(offset, length) of every record: from the indexes, and by a scan for members that no index names."""
        named: set[str] = set()
        for name in sorted(self.members):
            if name.startswith("indexes/") and name.endswith(".jsonl"):
                start, length = self.place(name)
                places = {}
                for line in self.file.read_at(length, start).splitlines():
                    x = json.loads(line)
                    if x["member"] not in places:
                        places[x["member"]] = self.place(x["member"])[0]
                    yield places[x["member"]] + x["offset"], x["length"]
                named |= set(places)
        for name in sorted(self.members):
            if name not in named and name.endswith(".warc.gz"):
                yield from self._scan(*self.place(name), window)

    def _scan(self, start: int, length: int, window: int) -> Iterator[tuple[int, int]]:
        """Borders of the gzip members, found by inflating window by window."""
        at, end, began = start, start + length, start
        inflate, pending = zlib.decompressobj(31), b""
        while at < end or pending:
            if not pending:
                pending = self.file.read_at(min(window, end - at), at)
                at += len(pending)
            inflate.decompress(pending)
            pending = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                stop = at - len(pending)
                yield began, stop - began
                began, inflate = stop, zlib.decompressobj(31)


READ_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, run_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """All records of the archives in (uri): one row per record.

    First the directories and indexes give runs of neighbouring records of about
    ``run_bytes``; the runs are dealt evenly, then each is one range read.
    """

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = open_uri(uri)
                runs: list[tuple[int, list[int]]] = []
                with fs.open_input_file(path) as file:
                    for offset, length in sorted(ZipDirectory(file).records()):
                        if runs and sum_ + length <= run_bytes and offset == runs[-1][0] + sum_:
                            runs[-1][1].append(length)
                            sum_ += length
                        else:
                            runs.append((offset, [length]))
                            sum_ = length
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.list_(pa.int64()))], ["uri", "offset", "lengths"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for uri, offset, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, path = open_uri(uri)
                with fs.open_input_file(path) as file:
                    data = memoryview(file.read_at(sum(lengths), offset))
                rows, at = [], 0
                for length in lengths:
                    row = parse_record(gzip.decompress(data[at : at + length]))
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    at += length
                yield pa.RecordBatch.from_pylist(rows, schema)

    # Rows of both tables are small and stand for much reading, so they are dealt by number, not by size.
    uris = staged(archives.select("uri"), "warc-uris")
    runs = staged(uris.repartition(_tasks(uris), "uri").mapInArrow(plan, "uri string, offset long, lengths array<long>"), "warc-runs")
    return runs.repartition(_tasks(runs), "uri", "offset").mapInArrow(read, READ_SCHEMA)


def _tasks(rows: DataFrame, most: int = 20_000) -> int:
    """One task per row, up to ``most``."""
    return max(1, min(most, rows.count()))


def qualified(spark: SparkSession, path: str) -> str:
    """Path with the scheme of the file system that Spark uses for it, in a form that tasks can open."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to ZIP-packaged WARC archives in the shared folder and read them back."""
    prepare(spark)
    pages = read_table(spark, sf_dir, "pages")
    archives = write_archives(pages, qualified(spark, scratch_path(spark, "warc")))
    found = read_archives(archives, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
