"""WARC archives: writing records with revisits, and a reader that recovers what follows damage."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.session import written

# The WARC format's version line, record names and profile.
VERSION = b"WARC/1."
END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"
PART = 1 << 14
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# Bytes after which a task goes on with another file, and the folder column that counts a task's files. A file is
# read as one value of at most 2 GB, as is the longest text of a table.
FILE_BYTES = 64 << 20
FILE = "part-file"
# Most groups of copies that are sent to every executor; more are joined by a shuffle.
SENT_GROUPS = 200_000


def records_of(pages: DataFrame, id_col: str, url_col: str, body_col: str, least: int, date: str) -> DataFrame:
    """(value): the text of one record per page, without the blank lines that end it."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"\s", "%20").alias("url"),
        body.alias("body"),
        F.octet_length(body).cast("long").alias("bytes"),
        F.sha1(body.cast("binary")).alias("sha1"),
    )
    copies = rows.filter(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    copies = written(copies.select("sha1", "bytes", "first"), "warc-copies")
    if copies.count() <= SENT_GROUPS:
        copies = F.broadcast(copies)
    rows = rows.join(copies, ["sha1", "bytes"], "left")
    revisit = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("body")))
    rows = rows.withColumn("revisit", revisit).withColumn("block", block)
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("block").cast("binary")))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(SAME_PAYLOAD)), line("WARC-Refers-To", name(F.col("first"))), line("X-Payload-Length", F.col("bytes")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block")),
    )
    return rows.select(F.concat(head, F.lit("\r\n"), F.col("block")).alias("value"))


def cut_by_bytes(records: DataFrame, file_bytes: int) -> DataFrame:
    """``records`` with the number, within its task, of the file that each record goes to.

    A file takes the records that begin in the same ``file_bytes`` of a task's running sum, so it is longer
    than that by less than one record.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False).astype(np.int64) + len(END)
            ends = before + np.cumsum(sizes)
            files = pa.array((ends - sizes) // file_bytes, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("value"), files], names=["value", FILE])
            before = int(ends[-1]) if len(ends) else before

    return records.select("value").mapInArrow(number, f"value string, `{FILE}` long")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000, per_file: int = 0, date: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Write one record per page as plain WARC files below ``path``, of ``file_bytes`` and less than one record more.

    Of pages with the same payload of at least ``least`` bytes, that with the largest id becomes a response;
    the others become revisits that name it. Null payloads are empty ones, null urls too. Rows that repeat the
    response's id and payload are responses as well. A group of copies without any id is all responses.
    ``date`` is the time of capture as ISO 8601 text in UTC, by default that of the call; tasks that run again write the same.
    ``per_file`` also bounds the records of a file, where it is not 0.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = cut_by_bytes(records_of(pages, id_col, url_col, body_col, least, date), file_bytes)
    records.write.partitionBy(FILE).option("lineSep", END.decode()).option("maxRecordsPerFile", per_file).text(path)


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        if self.headers.get("content-type", "").startswith("application/http"):
            return self.block.partition(END)[2]
        return self.block


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)

    def gap(self, start: int, end: int, reason: str) -> None:
        if start >= end:
            return
        if self.gaps and self.gaps[-1][1] == start:
            self.gaps[-1] = (self.gaps[-1][0], end, self.gaps[-1][2])
        else:
            self.gaps.append((start, end, reason))


DIGESTS = {"sha1", "sha256", "sha512", "md5"}
CHUNKED = re.compile(rb"^transfer-encoding:[^\r\n]*chunked", re.I | re.M)
CHUNK = re.compile(rb"([0-9a-fA-F]+)[^\r\n]*\r\n")


def _differs(given: str, data: bytes) -> bool:
    """Whether a digest in hex, base32 or base64 is that of other bytes. One of another kind or length cannot be compared."""
    kind, _, value = given.partition(":")
    kind, value = kind.strip().lower().replace("-", ""), value.strip().rstrip("=")
    if kind not in DIGESTS:
        return False
    raw = hashlib.new(kind, data).digest()
    if len(value) == 2 * len(raw):
        return value.lower() != raw.hex()
    for text, found in ((base64.b32encode(raw), value.upper()), (base64.b64encode(raw), value)):
        if len(found) == len(text.rstrip(b"=")):
            return found != text.rstrip(b"=").decode()
    return False


def _unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while found := CHUNK.match(body, at):
        size = int(found[1], 16)
        if not size:
            break
        parts.append(body[found.end() : found.end() + size])
        at = found.end() + size + 2
    return b"".join(parts)


def _payload_differs(headers: dict[str, str], block: bytes) -> bool:
    """Whether a whole response's payload is not the digest's, as stored or freed from its chunks."""
    given = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "response" or not given or "warc-truncated" in headers or "warc-segment-number" in headers:
        return False
    if not headers.get("content-type", "").startswith("application/http"):
        return _differs(given, block)
    head, end, body = block.partition(END)
    return bool(end) and _differs(given, body) and not (CHUNKED.search(head) and not _differs(given, _unchunked(body)))


VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")


def _record(data: bytes, at: int) -> tuple[Record | None, int, str]:
    """(record, where it ends, fault) of what starts at a place."""
    if not VERSION_LINE.match(data, at):
        return None, at, "no version line"
    end = data.find(END, at)
    if end < 0:
        return None, at, "header does not end"
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            return None, at, "broken header line"
        headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, at, "no length"
    start = end + len(END)
    stop = start + int(length)
    if data[stop : stop + len(END)] != END:
        return None, at, "length does not lead to the record's end"
    block = data[start:stop]
    if _differs(headers.get("warc-block-digest", ""), block):
        return None, at, "digest differs"
    if _payload_differs(headers, block):
        return None, at, "payload digest differs"
    return Record(at, headers, block), stop + len(END), ""


def salvage_plain(data: bytes, base: int = 0) -> Salvage:
    """All sound records of a plain archive; after a failed check the search goes on at the next version line."""
    out, at = Salvage(), 0
    while at < len(data):
        record, after, fault = _record(data, at)
        if record:
            record.offset += base
            out.records.append(record)
            at = after
            continue
        found = VERSION_LINE.search(data, at + 1)
        after = found.start() if found else len(data)
        out.gap(base + at, base + after, fault)
        at = after
    return out


def salvage_gzip(data: bytes) -> Salvage:
    """All sound records of an archive of gzip members; after a broken member the search goes on at the next one."""
    out, at, view = Salvage(), 0, memoryview(data)
    while at < len(data):
        if data.startswith(GZIP, at):
            member, parts, after, fault = zlib.decompressobj(wbits=31), [], at, ""
            try:
                while after < len(data) and not member.eof:
                    parts.append(member.decompress(view[after : after + PART]))
                    after = min(after + PART, len(data))
                after -= len(member.unused_data)
                fault = "" if member.eof else "member does not end"
            except zlib.error as error:
                fault = f"broken member: {error}"
            if not fault:
                found = salvage_plain(b"".join(parts))
                for record in found.records:
                    record.offset = at
                out.records.extend(found.records)
                if found.gaps:  # byte places inside a member have no place in the file: the member stands for them
                    out.gap(at, after, found.gaps[0][2])
                at = after
                continue
        else:
            fault = "no member"
        after = data.find(GZIP, at + 1)
        after = len(data) if after < 0 else after
        out.gap(at, after, fault)
        at = after
    return out


def salvage(data: bytes) -> Salvage:
    return salvage_gzip(data) if data[:3] == GZIP or (VERSION not in data and GZIP in data) else salvage_plain(data)


READ = "kind string, file string, offset long, length long, reason string, record_id string, record_type string, uri string, payload_bytes long, payload_digest string, refers_to string, payload string"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, glob: str = "*") -> DataFrame:
    """Records (kind ``record``) and quarantined byte gaps (kind ``gap``) of all archives below a path.

    All files below it whose name fits ``glob`` are read, but those that Spark hides (names that begin with ``_`` or ``.``).
    Records are checked by version line, header, length, block digest and, for whole responses, payload digest. A file is read by one task, so
    archives should be written in files that fit its memory, as ``write_warc`` does; one above 2 GB fails the job and is not left out. Empty files give no rows. Payloads are decoded
    as UTF-8, bytes that are none by the replacement character; digests and lengths come from the bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                found, rows = salvage(data), []
                for r in found.records:
                    payload, h = r.payload(), r.headers
                    kind = h.get("warc-type")
                    if kind == "revisit":
                        given = h.get("x-payload-length", "")
                        size = int(given) if given.isdigit() else None
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    text = payload.decode("utf-8", "replace") if with_payload else None
                    rows.append(("record", file, r.offset, len(r.block), None, h.get("warc-record-id"), kind, h.get("warc-target-uri"), size, digest, h.get("warc-refers-to"), text))
                rows += [("gap", file, start, end - start, reason, *[None] * 7) for start, end, reason in found.gaps]
                for i in range(0, len(rows), 1000):
                    yield pd.DataFrame(rows[i : i + 1000], columns=names).astype({"payload_bytes": "Int64"})

    names = [c.split()[0] for c in READ.split(", ")]
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, READ)


def page_of(record_id: Column) -> Column:
    """The page id in a record's name; null where the page had none."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
