import hashlib
import io
import struct
import zipfile

import pytest

from rankwell.llm import warc_zip as Z

SCHEMA = "page_id long, url string, html string"


class Bytes:
    """A file in memory that counts what is read."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


def rows():
    same, longer = "x" * 150, "é" * 60
    return [(5, "http://a", same), (3, "http://b c\n", same), (9, None, same), (7, "u", "short"), (8, "u", "short"), (10, "u", None), (11, "u", ""),
            (12, "u", longer), (None, "u", longer), (13, "u", longer), (3, "http://b", same), (14, "u", "z" * 400_000)]


def expected(data):
    out = []
    for page_id, _, html in data:
        payload = (html or "").encode()
        same = [i for i, _, h in data if (h or "").encode() == payload and i is not None]
        first = min(same, default=None)
        refers = first if len(payload) >= 100 and len([1 for _, _, h in data if (h or "").encode() == payload]) > 1 and first is not None and page_id != first else None
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 as digest", "2 as size", "3 as payload")
    archives = Z.write_archives(df, f"file://{tmp_path}/a", archive_records=3, member_bytes=200)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows())
    out = Z.read_archives(archives, run_bytes=300).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == expected(rows())
    payloads = {(h or "").encode() for _, _, h in rows()}
    assert all(bytes(r.payload) in payloads for r in out if r.record_type == "response")
    assert {r.url for r in out if r.page_id == 3} == {"http://b%20c%0A", "http://b"}


def test_archives_are_plain_zip_files(spark, tmp_path):
    archives = Z.write_archives(spark.createDataFrame(rows(), SCHEMA).coalesce(1), f"file://{tmp_path}/a", member_bytes=300)
    for r in archives.collect():
        with zipfile.ZipFile(r.uri.removeprefix("file://")) as z:
            assert z.testzip() is None
            assert all(m.compress_type == zipfile.ZIP_STORED for m in z.infolist())


def test_empty_table(spark, tmp_path):
    archives = Z.write_archives(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/a")
    assert archives.collect() == [] and Z.read_archives(archives).collect() == []


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    archives = Z.write_archives(spark.createDataFrame(rows(), SCHEMA), f"file://{tmp_path}/a")
    (tmp_path / "a" / "orphan.zip").write_bytes(b"half an archive")
    assert Z.read_archives(archives).count() == len(rows())


def records(n):
    return [Z.record(i, "u", b"p%d" % i, 2, hashlib.sha256(b"p%d" % i).hexdigest(), None, "2000-01-01T00:00:00Z") for i in range(n)]


def archive(n=5, index=True, comment=b""):
    import gzip

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc.gz", b"".join(gzip.compress(r) for r in records(n)))
        z.writestr("other.txt", b"text", zipfile.ZIP_DEFLATED)
        z.comment = comment
    return buf.getvalue()


def read_all(data):
    import gzip

    f = Bytes(data)
    return [Z.parse_record(gzip.decompress(f.read_at(n, at)))["page_id"] for at, n in Z.ZipDirectory(f).records(window=37)]


def test_members_without_an_index_are_scanned():
    assert read_all(archive()) == list(range(5))
    assert read_all(archive(comment=b"PK\x05\x06 in a comment, " * 20)) == list(range(5))


def test_zip64_directory():
    """Large values are moved to the ZIP64 fields, as in archives over 4 GB."""
    data = archive()
    end = data.rfind(b"PK\x05\x06")
    n, length, start = struct.unpack_from("<HII", data, end + 10)
    directory, at, out = data[start : start + length], 0, b""
    for _ in range(n):
        packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        extra = struct.pack("<HHQQQ", 1, 24, size, packed, header)
        entry = bytearray(directory[at : at + 46])
        struct.pack_into("<IIHHH", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF, n_name, len(extra), 0)
        struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
        out += bytes(entry) + directory[at + 46 : at + 46 + n_name] + extra
        at += 46 + n_name + n_extra + n_comment
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(out), start)
    locator = struct.pack("<IIQI", 0x07064B50, 0, start + len(out), 1)
    tail = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert read_all(data[:start] + out + end64 + locator + tail) == list(range(5))


def test_only_ranges_are_read():
    big = Bytes(archive(400))
    d = Z.ZipDirectory(big)
    assert big.read <= 22 + 65535 + 400 and "archive/data.warc.gz" in d.members


@pytest.mark.parametrize("data", [b"", b"no archive at all", b"PK\x05\x06"])
def test_damaged_files_fail(data):
    with pytest.raises(ValueError):
        Z.ZipDirectory(Bytes(data))


def test_damaged_payload_and_compressed_member_fail():
    r = records(1)[0]
    with pytest.raises(ValueError, match="digest"):
        Z.parse_record(r.replace(b"p0", b"q0"))
    with pytest.raises(ValueError, match="stored"):
        Z.ZipDirectory(Bytes(archive())).place("other.txt")
