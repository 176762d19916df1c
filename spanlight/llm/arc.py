"""WARC records from legacy ARC archives.

An ARC file is a version block and records of one header line and as many bytes
as that line declares; the line's fields depend on the version. The converter
gives each record what WARC asks for and ARC lacks: an identifier made from the
archive's name, the record's place in it and its payload's digest, a type, an ISO
timestamp and digests. Equal payloads become revisits of the first.

Archives are files of about ARCHIVE_BYTES on shared storage, of many records each;
WARC files have a gzip member for each record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, attach, materialize, new_path, table

#: Fields of a record's header line by ARC version (fixed values).
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
CRLF = b"\r\n"
DATE = "20240101000000"
#: Payloads under so many bytes are all written whole. Equal ones from here on are revisits.
MIN_REVISIT_BYTES = 0
#: A header that a crawl may have written into its responses: the source's integer key of a record.
SOURCE_ID = "X-Source-Id"
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 32 << 20
#: Records of a legacy archive at most.
ARCHIVE_RECORDS = 5000
#: gzip's level: archives are written once and read back soon.
LEVEL = 1


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    offset: int


def arc_file(records: list[tuple[str, str, bytes]], version: int = 1, name: str = "pages.arc") -> bytes:
    """An ARC file of (url, mime, block) records, as a crawler of that version wrote it."""
    names = b"URL IP-address Archive-date Content-type Archive-length" if version == 1 else b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    body = b"%d 0 spanlight\n%s\n" % (version, names)
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain".encode()
    if version == 2:
        line += f" 200 - - 0 {name}".encode()
    out = [line + b" %d\n" % len(body), body, b"\n"]
    at = sum(map(len, out))
    for url, mime, block in records:
        clean = quote(url, safe="".join(map(chr, range(33, 127)))) or "urn:unknown"
        line = f"{clean} 0.0.0.0 {DATE} {mime}".encode()
        if version == 2:
            line += f" 200 - - {at} {name}".encode()
        piece = line + b" %d\n" % len(block) + block + b"\n"
        out.append(piece)
        at += len(piece)
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file. Raises ValueError where a header line or a declared length doesn't fit."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        parts = data[at:end].decode("latin-1").rstrip("\r").split(" ")
        if not version:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with a filedesc record")
            said = data[end + 1 : data.find(b" ", end + 1)]
            version = int(said) if said.isdigit() else 0
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {said!r}")
            first = True
        else:
            first = False
        fields = FIELDS[version]
        if len(parts) < len(fields) or not parts[-1].isdigit():
            raise ValueError(f"a version {version} header line has {len(fields)} fields: {parts}")
        # Old crawlers left spaces in URLs: the fields after it are counted from the right.
        got = dict(zip(fields[1:], parts[len(parts) - len(fields) + 1 :], strict=True)) | {"url": " ".join(parts[: len(parts) - len(fields) + 1])}
        length, begin = int(got["length"]), end + 1
        if begin + length > len(data):
            raise ValueError(f"the record at byte {at} declares {length} bytes; {len(data) - begin} are left")
        if not first:
            yield ArcRecord(got["url"], got["ip"], got["date"], got["mime"], data[begin : begin + length], at)
        at = begin + length


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source: str, offset: int, digest: str) -> str:
    """An identifier of a record by its archive, place and payload: the same whenever the archive is converted (a version 8 UUID)."""
    h = bytearray(hashlib.sha256(f"{source}\n{offset}\n{digest}".encode()).digest()[:16])
    h[6], h[8] = h[6] & 0x0F | 0x80, h[8] & 0x3F | 0x80
    x = h.hex()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header lines (with the empty line) and payload of an HTTP response; a block without them is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def header(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?:\A|\r\n)" + re.escape(name.encode()) + rb":[ \t]*([^\r]*)", head, re.IGNORECASE)
    return m[1].decode("utf-8", "replace") if m else None


def iso(date: str) -> str:
    """A 14-digit ARC date, or the 12 or 8 digits of older ones, as WARC writes it."""
    d = (date + "01010000000000"[len(date) - 4 :])[:14] if 4 <= len(date) < 14 else date[:14]
    d = d if re.fullmatch(r"\d{14}", d) else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def warc_record(id_: str, url: str, ip: str, date: str, http: bytes, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record with the two line ends that follow it. With refers_to it is a revisit: the HTTP header lines stay and the payload goes."""
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {id_}",
        f"WARC-Date: {iso(date)}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + CRLF + CRLF


def warc_info(id_: str) -> bytes:
    """The record that begins a WARC file."""
    body = b"software: spanlight\r\nformat: WARC File Format 1.0\r\n"
    return f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {id_}\r\nWARC-Date: {iso(DATE)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + CRLF + CRLF


class WarcReader:
    """Records from bytes that arrive in parts; holds one record at most."""

    def __init__(self) -> None:
        self.held = b""

    def push(self, data: bytes) -> Iterator[tuple[bytes, bytes]]:
        self.held += data
        at = 0
        while True:
            while self.held[at : at + 2] == CRLF:
                at += 2
            end = self.held.find(b"\r\n\r\n", at)
            if end < 0:
                break
            head = self.held[at:end]
            if not head.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {head[:40]!r}")
            begin, length = end + 4, int(header(head, "Content-Length") or 0)
            if begin + length > len(self.held):
                break
            yield head, self.held[begin : begin + length]
            at = begin + length
        self.held = self.held[at:]


CONVERTED = "id string, key long, url string, ip string, date string, http binary, payload binary, digest string, n long"
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def write_archives(archives: DataFrame, path: str, last: str) -> None:
    """archives: (value binary), a whole archive a row, without its last byte, which is `last`. Each row becomes a file of its own."""
    archives.select(F.col("value").cast("string")).write.option("lineSep", last).option("maxRecordsPerFile", 1).text(path)


def from_arc(spark, path: str) -> DataFrame:
    """One row a record of the ARC files in a folder, gzipped or not: what a WARC record of it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(*batch.columns, strict=True):
                source, rows = name.as_py().rsplit("/", 1)[-1], []
                data = data.as_py()
                for r in parse_arc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    http, payload = split_http(r.block)
                    key, digest = header(http, SOURCE_ID), sha1_32(payload)
                    rows.append((record_id(source, r.offset, digest), int(key) if key and re.fullmatch(r"-?\d{1,18}", key) else None, r.url, r.ip, r.date, http, payload, digest, len(payload)))
                    if len(rows) == 128:
                        yield _batch(CONVERTED, rows)
                        rows = []
                if rows:
                    yield _batch(CONVERTED, rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, CONVERTED)


def with_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Adds refers_to: the id of the first record with that payload (least key, null keys last, then least id), or null for a response.

    Records of the first one's key are the same capture, and responses too. What
    decides is computed from keys, ids and digests; a payload that very many
    records share meets its first one by broadcast, so no task gets all of them.
    """
    order = F.struct(F.col("key").isNull().alias("none"), "key", "id")
    same = records.where(F.col("n") >= min_bytes).groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("deg")).where("deg > 1")
    same = materialize(same, "warc-first")
    n = same.agg(F.coalesce(F.sum("deg"), F.lit(0)).alias("n")).first()["n"]
    often = F.broadcast(same.where(F.col("deg") > n / HEAVY).select("digest", F.col("first").alias("often")))
    rest = same.where(F.col("deg") <= n / HEAVY).select(F.col("digest").alias("meets"), F.col("first").alias("seldom"))
    # A record that has its first one already meets nothing: its own id spreads it.
    met = records.join(often, "digest", "left").withColumn("meets", F.when(F.col("often").isNull(), F.col("digest")).otherwise(F.col("id"))).join(rest, "meets", "left")
    met = met.withColumn("first", F.coalesce("often", "seldom")).drop("meets", "often", "seldom")
    revisit = F.col("first").isNotNull() & (F.col("n") >= min_bytes) & (F.col("id") != F.col("first.id")) & ~F.coalesce(F.col("key") == F.col("first.key"), F.lit(False))
    return met.withColumn("refers_to", F.when(revisit, F.col("first.id"))).drop("first")


def _members(record: bytes) -> bytes:
    """A gzip member whose last byte is 0, the high byte of its size; a record of 2^24 bytes or more ends in a second, short one."""
    if len(record) < 1 << 24:
        return gzip.compress(record, LEVEL, mtime=0)
    return gzip.compress(record[:-4], LEVEL, mtime=0) + gzip.compress(record[-4:], LEVEL, mtime=0)


def write_warc(records: DataFrame, path: str) -> None:
    """Writes WARC files of about ARCHIVE_BYTES, a gzip member a record, a warcinfo record first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                for r in part.to_pylist():
                    if not parts:
                        parts.append(_members(warc_info(record_id("warcinfo", 0, r["id"]))))
                    parts.append(_members(warc_record(r["id"], r["url"], r["ip"], r["date"], r["http"], r["payload"], r["digest"], r["refers_to"])))
                    size += len(parts[-1])
                    if size >= ARCHIVE_BYTES:
                        yield _batch("value binary", [(b"".join(parts)[:-1],)])
                        parts, size = [], 0
        if parts:
            yield _batch("value binary", [(b"".join(parts)[:-1],)])

    write_archives(records.mapInArrow(run, "value binary"), path, "\0")


READ = "id string, key long, payload_bytes long, payload_digest string, record_type string, refers string"


def read_warc(spark, path: str) -> DataFrame:
    """One row a response or revisit of the WARC files in a folder, digests checked where the payload is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = memoryview(data.as_buffer())
                reader, unzip = WarcReader(), zlib.decompressobj(31)
                out: list[tuple] = []
                for at in range(0, len(raw), 1 << 16):
                    piece = raw[at : at + (1 << 16)]
                    while len(piece):
                        out += [_read(head, block) for head, block in reader.push(unzip.decompress(piece)) if header(head, "WARC-Type") != "warcinfo"]
                        piece = unzip.unused_data
                        if unzip.eof:
                            unzip = zlib.decompressobj(31)
                    if len(out) >= 1024:
                        yield _batch(READ, out)
                        out = []
                if reader.held.strip():
                    raise ValueError("a WARC file ends within a record")
                yield _batch(READ, out)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, READ)


def _read(head: bytes, block: bytes) -> tuple:
    http, payload = split_http(block)
    kind, digest = header(head, "WARC-Type"), (header(head, "WARC-Payload-Digest") or "").removeprefix("sha1:")
    key = header(http, SOURCE_ID)
    if kind == "response":
        if sha1_32(payload) != digest:
            raise ValueError("a payload differs from its digest")
        n = len(payload)
    else:
        n = int(header(http, "Content-Length") or 0)
    return header(head, "WARC-Record-ID"), int(key) if key else None, n, digest, kind, header(head, "WARC-Refers-To")


def write_arc(pages: DataFrame, path: str) -> None:
    """(page_id, url, html) -> gzipped legacy ARC files of many HTTP responses, of version 1 and 2 in turn.

    A null html has an empty payload, a null url the target urn:unknown; a null
    page_id no source header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, version = [], 0, 1
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                for key, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    payload = (html or "").encode("utf-8")
                    own = f"{SOURCE_ID}: {key}\r\n" if key is not None else ""
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
                    held.append((url or "", "text/html", http + payload))
                    size += len(payload)
                    if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                        yield _batch("value binary", [(_members(arc_file(held, version))[:-1],)])
                        held, size, version = [], 0, 3 - version
        if held:
            yield _batch("value binary", [(_members(arc_file(held, version))[:-1],)])

    made = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "value binary")
    write_archives(made, path, "\0")


def refers_to_keys(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: the key of the record that a revisit names."""
    named = read.where("refers IS NOT NULL").groupBy(F.col("refers").alias("id")).agg(F.count("*").alias("deg"))
    keys = materialize(read.where("record_type = 'response'").select("id", F.col("key").alias("refers_to")).join(named, "id").withColumnRenamed("id", "refers"), "warc-named")
    columns = [F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    whole = read.where("refers IS NULL").withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
    revisits = read.where("refers IS NOT NULL")
    return whole.unionByName(attach(revisits, "refers", keys, revisits.count()).select(*columns))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Legacy archives of all pages on shared storage, converted, written as WARC and read back."""
    legacy, path = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(table(spark, sf_dir, "pages"), legacy)
    write_warc(with_revisits(from_arc(spark, legacy)), path)
    return refers_to_keys(materialize(read_warc(spark, path), "warc-read"))


OP3_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
bits AS (
  SELECT page_id, n, hex,
         list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           ((('0x' || substr(hex || '00', 1 + CAST(floor(i * 5 / 4) AS INT), 3))::BIGINT >> (7 - CAST((i * 5) % 4 AS INT))) & 31) AS INT), 1)), 'string_agg', '') AS digest
  FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM bits)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
