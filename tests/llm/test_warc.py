import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from folioscan.llm.warc import page_of, read_warc, salvage, write_warc
from folioscan.session import scratch_path

SCHEMA = "page_id long, url string, html string, sha1 string, first long, value string"


def archive(spark, table, rows, **kw):
    path = scratch_path(spark, "warc-test")
    write_warc(table([(*r, "clash", 1, "clash") for r in rows], SCHEMA), path, **kw)
    return path


def test_round_trip(spark, table):
    big, tricky = "é" * 700, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" + "y" * 1000
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * 300) for i in range(60)]
    rows += [(100, "http://b", big), (101, "http://c", big), (102, None, big), (103, "u", tricky), (104, "u\nv", ""), (105, "w", None), (106, "s", "small"), (107, "s", "small")]
    path = archive(spark, table, rows, per_file=9)
    found = {r.page_id: r for r in read_warc(spark, path).withColumn("page_id", page_of(F.col("record_id"))).withColumn("to", page_of(F.col("refers_to"))).collect()}
    assert len(found) == len(rows)
    for id_, _, body in rows:
        data, r = (body or "").encode(), found[id_]
        assert r.kind == "record" and r.payload_bytes == len(data) and r.payload_digest == hashlib.sha1(data).hexdigest()
        if id_ in (100, 101):
            assert (r.record_type, r.to, r.payload) == ("revisit", 102, "")
        else:
            assert (r.record_type, r.to, r.payload) == ("response", None, body or "")


def test_records_have_the_named_fields(spark, table):
    """The fields that every record must have, one date for a whole write, and nothing left over."""
    body = "z" * 2000
    path = archive(spark, table, [(1, "http://a", body), (2, "http://b", body), (3, "http://c", None)], date="2020-02-03T04:05:06Z")
    found = [salvage(bytes(r.content)) for r in spark.read.format("binaryFile").load(f"{path}/part-*").collect()]
    records = [r for f in found for r in f.records]
    assert len(records) == 3 and not any(f.gaps for f in found)
    for r in records:
        assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= r.headers.keys()
        assert r.headers["warc-date"] == "2020-02-03T04:05:06Z"


def test_files_are_cut_by_bytes(spark, table):
    """No file is longer than the budget and one record, also where a record is longer than the budget."""
    rows = [(i, "u", chr(97 + i % 26) * (30_000 if i % 10 == 0 else 400) + str(i)) for i in range(200)]
    path = archive(spark, table, rows, file_bytes=8000)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).collect()]
    found = [salvage(data) for data in files]
    assert sum(len(f.records) for f in found) == len(rows) and not any(f.gaps for f in found)
    for data, f in zip(files, found, strict=True):
        assert max(r.offset for r in f.records) < 8000 and len(data) < 8000 + 32_000
    assert len(files) > 30 and {page_of_text(r.headers["warc-record-id"]) for f in found for r in f.records} == {str(i) for i in range(200)}


def test_ties_and_missing_ids(spark, table):
    body = "z" * 2000
    path = archive(spark, table, [(5, "a", body), (5, "a", body), (3, "a", body), (None, "a", body)])
    found = sorted((r.record_type, page_of_text(r.record_id), r.refers_to) for r in read_warc(spark, path).collect())
    assert found == [("response", "5", None), ("response", "5", None), ("response", "null", None), ("revisit", "3", "<urn:page:5>")]
    path = archive(spark, table, [(None, "a", body), (None, "b", body)])
    assert [r.record_type for r in read_warc(spark, path).collect()] == ["response", "response"]
    assert read_warc(spark, archive(spark, table, [])).collect() == []


def page_of_text(record_id):
    return record_id.removeprefix("<urn:page:").removesuffix(">")


def record(body: bytes, name: str = "n") -> bytes:
    digest = hashlib.sha1(body).hexdigest()
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{name}>\r\nWARC-Block-Digest: sha1:{digest}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def names(found):
    return [r.headers["warc-record-id"] for r in found.records]


def test_salvage_of_plain_files():
    one, two, three = (record(b"body %d" % i, str(i)) for i in range(3))
    assert names(salvage(one + two + three)) == ["<0>", "<1>", "<2>"] and not salvage(one + two + three).gaps
    damaged = one + two.replace(b"body", b"b0dy") + three
    found = salvage(damaged)
    assert names(found) == ["<0>", "<2>"] and found.gaps == [(len(one), len(one + two), "digest differs")]
    found = salvage(b"junk" + one + two[: len(two) // 2] + three[:-1])
    assert names(found) == ["<0>"] and [g[:2] for g in found.gaps] == [(0, 4), (4 + len(one), 4 + len(one) + len(two) // 2 + len(three) - 1)]
    found = salvage(one + two.replace(b"Content-Length: 6", b"Content-Length: 9") + three)
    assert names(found) == ["<0>", "<2>"] and "length" in found.gaps[0][2]
    assert salvage(b"").records == [] and salvage(b"\0" * 50).gaps == [(0, 50, "no version line")]


def test_salvage_of_gzip_members():
    parts = [gzip.compress(record(bytes([65 + i]) * 40_000, str(i))) for i in range(4)]
    found = salvage(b"".join(parts))
    assert names(found) == ["<0>", "<1>", "<2>", "<3>"] and not found.gaps
    broken = bytearray(parts[1])
    broken[len(broken) // 2] ^= 0xFF
    found = salvage(parts[0] + bytes(broken) + b"noise" + parts[2] + parts[3][:-4])
    assert names(found) == ["<0>", "<2>"]
    start = len(parts[0])
    assert [g[:2] for g in found.gaps] == [(start, start + len(broken) + 5), (start + len(broken) + 5 + len(parts[2]), sum(map(len, parts)) + 1)]


def test_gaps_are_rows(spark, tmp_path):
    one, two = record(b"a", "1"), record(b"b", "2")
    (tmp_path / "part-0.warc").write_bytes(one + b"lost bytes" + two)
    rows = sorted((r.kind, r.offset, r.length) for r in read_warc(spark, str(tmp_path)).collect())
    assert rows == [("gap", len(one), 10), ("record", 0, 1), ("record", len(one) + 10, 1)]


def response(body: bytes, name: str, coded, block: bool, head: bytes = b"HTTP/1.1 200 OK", payload: bytes | None = None) -> bytes:
    """A response with a payload digest, and a block digest where asked for."""
    whole = head + b"\r\n\r\n" + body
    digests = f"WARC-Payload-Digest: sha1:{coded(body if payload is None else payload)}\r\n" + (f"WARC-Block-Digest: sha1:{coded(whole)}\r\n" if block else "")
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{name}>\r\n{digests}Content-Type: application/http\r\nContent-Length: {len(whole)}\r\n\r\n".encode() + whole + b"\r\n\r\n"


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_digests_in_base32_and_of_payloads():
    for coded in (base32, lambda data: hashlib.sha1(data).hexdigest()):
        for block in (True, False):
            one, two = response(b"first page", "1", coded, block), response(b"other page", "2", coded, block)
            assert names(salvage(one + two)) == ["<1>", "<2>"]
            found = salvage(one.replace(b"first page", b"f1rst page") + two)
            assert names(found) == ["<2>"] and found.gaps[0][:2] == (0, len(one)) and "digest differs" in found.gaps[0][2]
    chunked = response(b"3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n", "3", base32, True, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked", b"abcde")
    assert names(salvage(chunked)) == ["<3>"]


def test_archives_of_any_name(spark, tmp_path):
    good, bad = response(b"first page", "1", base32, True), response(b"other page", "2", base32, True).replace(b"other page", b"0ther page")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(bad))
    (tmp_path / "y.warc").write_bytes(good)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    found = sorted((r.kind, r.file.rsplit("/", 1)[1]) for r in read_warc(spark, str(tmp_path)).collect())
    assert found == [("gap", "x.warc.gz"), ("record", "x.warc.gz"), ("record", "y.warc")]
    assert read_warc(spark, str(tmp_path), glob="*.warc").count() == 1
