"""Legacy archives: ARC files (versions 1 and 2) converted to WARC, written as gzipped WARC files and read back.

An ARC file begins with a version block, whose second line gives the version and whose third names the
fields of the header lines that follow.  Version 1 lines have five fields, version 2 lines ten; a URL
may hold spaces, so lines are split from the right.  The declared length of each record delimits it; a
length beyond the end marks a truncated record, and a line that is no header is skipped up to the next
one that is.  The converter synthesises what ARC lacks: record identifiers (UUIDs of version 5 over URL,
date, place and digest), ISO timestamps, record types (from the scheme and the HTTP status line) and
SHA-1 digests of block and payload.

Rows: null URLs become ``unknown:``, null payloads empty ones, a null key sorts after every other key.
Rows that tie in payload and key, repeated rows too, are all of type response.  Payloads of any length are
whole records; an empty table gives an empty archive; only the three columns named are read, whatever others
are called.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import NULL_ID, Table, by_value, id_key, new_path, real_id, small_batches, table, utf8

by_value(__name__)

#: Fixed: the fields of header lines, by version of the format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Bytes of records written as one line, and such lines a file, at most: with a longer record a line is that record.
#: A file is parsed as a stream, and its gzipped bytes are one row.
LINE_BYTES, LINES_PER_FILE = 1 << 20, 256

END = b"\r\n\r\n"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    offset: int
    truncated: bool = False
    extra: dict = field(default_factory=dict)


def digest(raw: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def write_arc(name: str, date: str, records: list[tuple[str, str, str, str, bytes]], version: int = 1) -> bytes:
    """An ARC file of (url, ip, date, mime, body) records."""
    block = f"{version} 0 quillgraph\n{' '.join(FIELDS[version])}\n".encode()
    tail = {1: "", 2: f" 200 - - 0 {name}"}[version]
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain{tail} {len(block)}\n".encode(), block, b"\n"]
    for url, ip, when, mime, body in records:
        middle = "" if version == 1 else f" 200 {digest(body)} - {sum(map(len, out))} {name}"
        out += [f"{url} {ip} {when} {mime}{middle} {len(body)}\n".encode(), body, b"\n"]
    return b"".join(out)


def _header(line: bytes, version: int) -> list[str] | None:
    """The fields of a header line; None if it is none."""
    names = FIELDS[version]
    parts = line.decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
    ok = len(parts) == len(names) and parts[-1].isdigit() and parts[2].isdigit() and 4 <= len(parts[2]) <= 17 and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", parts[0])
    return parts if ok else None


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file (gzipped or not), its version block first; read as a stream."""
    stream = io.BufferedReader(_Unzipped(raw) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw), 1 << 18)
    at, version = 0, 0
    while (line := stream.readline()).endswith(b"\n"):
        start, at = at, at + len(line)
        line = line[:-1]
        parts = _header(line, version) if version else None
        layout, told = version, b""
        if not version:
            layout = next((v for v in (2, 1) if (p := _header(line, v)) and p[0].startswith("filedesc:")), 0)
            parts = _header(line, layout) if layout else None
        if parts is None:
            version = version or 1
            continue
        length = int(parts[-1])
        body = stream.read(length)
        at += len(body)
        if not version:
            told = body[:1].decode("latin-1")
            version = int(told) if told in ("1", "2") else layout
        yield ArcRecord(parts[0], parts[1], parts[2], parts[3], body, start, len(body) < length, dict(zip(FIELDS[layout][4:-1], parts[4:-1], strict=True)))
        if stream.peek(1)[:1] == b"\n":
            at += len(stream.read(1))


def iso_date(date: str) -> str:
    """ARC's YYYYMMDDhhmmss, completed where it is shorter, as WARC's timestamp."""
    full = (date + "00000101000000"[len(date) :])[:14] if len(date) < 14 else date[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes] | None:
    """HTTP head and payload; None where there is no status line."""
    if not body.startswith(b"HTTP/"):
        return None
    cut = re.search(rb"\r?\n\r?\n", body)
    return (body[: cut.end()], body[cut.end() :]) if cut else (body, b"")


@dataclass
class WarcRecord:
    headers: list[tuple[str, str]]
    block: bytes
    payload: bytes = b""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        """Without the two line ends that close a record."""
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers)
        return f"WARC/1.1\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode() + self.block


def convert(record: ArcRecord) -> WarcRecord:
    """The WARC record of an ARC record, with all that can be told from the record alone."""
    http = split_http(record.body)
    payload = http[1] if http else record.body
    scheme = record.url.partition(":")[0].lower()
    if scheme == "filedesc":
        kind, mime = "warcinfo", "application/warc-fields"
    elif http:
        kind, mime = "response", "application/http; msgtype=response"
    else:
        kind, mime = "resource", "text/dns" if scheme == "dns" else record.mime
    told = digest(payload)
    name = f"{record.url} {record.date} {record.offset} {told}"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", iso_date(record.date)),
        *([("WARC-Filename", record.url.removeprefix("filedesc://"))] if kind == "warcinfo" else [("WARC-Target-URI", record.url), ("WARC-IP-Address", record.ip)]),
        ("WARC-Block-Digest", f"sha1:{digest(record.body)}"),
        ("WARC-Payload-Digest", f"sha1:{told}"),
        *([("WARC-Truncated", "length")] if record.truncated else []),
        ("Content-Type", mime),
    ]
    return WarcRecord(headers, record.body, payload)


def as_revisit(record: WarcRecord, of: str) -> WarcRecord:
    """A revisit of an earlier record with the same payload: the HTTP head stays, the payload goes."""
    head = record.block[: len(record.block) - len(record.payload)]
    changed = {"WARC-Type": "revisit", "WARC-Block-Digest": f"sha1:{digest(head)}"}
    headers = [(k, changed.get(k, v)) for k, v in record.headers]
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", of), ("X-Payload-Length", str(len(record.payload)))]
    return WarcRecord(headers, head)


def read_warc(stream) -> Iterator[WarcRecord]:
    """Records of an unzipped stream, one at a time, by their declared lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:60]!r}")
        headers: list[tuple[str, str]] = []
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and headers:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip().decode()}")
            else:
                k, _, v = line.decode("utf-8", "replace").partition(":")
                headers.append((k.strip(), v.strip()))
        length = next(int(v) for k, v in headers if k.lower() == "content-length")
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("the archive ends within a record")
        http = split_http(block)
        yield WarcRecord([h for h in headers if h[0].lower() != "content-length"], block, http[1] if http else block)


class _Unzipped(io.RawIOBase):
    """A gzipped buffer as a readable stream; members follow one another; no more than a chunk is held."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.left = raw, 0, b""
        self.z = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left:
            if self.z.eof:
                rest = self.z.unused_data
                self.at -= len(rest)
                self.z = zlib.decompressobj(31)
            if self.at >= len(self.raw):
                return 0
            chunk = self.raw[self.at : self.at + (1 << 18)]
            self.at += len(chunk)
            self.left = self.z.decompress(chunk)
        n = min(len(into), len(self.left))
        into[:n] = self.left[:n]
        self.left = self.left[n:]
        return n


def record_id(key: int) -> str:
    """Identifier of the response that a revisit names, told from its key alone."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(key))}>"


def _to_warc(date: str, version: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, firsts, urls, payloads = (batch.column(i).to_pylist() for i in range(4))
            pages = []
            for url, payload in zip(urls, payloads, strict=True):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                address = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "unknown:")
                pages.append((address if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", address) else f"unknown:{address}", "0.0.0.0", date, "text/html", head + payload))
            out, lines, size = [], [], 0
            records = read_arc(write_arc("pages.arc", date, pages, version))
            next(records)  # the version block
            for key, first, record in zip(keys, firsts, map(convert, records), strict=True):
                record.headers = [(k, record_id(key) if k == "WARC-Record-ID" and key != NULL_ID else v) for k, v in record.headers]
                if first is not None and first != key:
                    record = as_revisit(record, record_id(first))
                    record.headers.append(("X-Refers-To-Key", str(first)))
                if key != NULL_ID:
                    record.headers.append(("X-Key", str(key)))
                raw = record.to_bytes()
                if out and size + len(raw) > LINE_BYTES:
                    lines.append(END.join(out))
                    out, size = [], 0
                out.append(raw)
                size += len(raw) + len(END)
            if out:
                lines.append(END.join(out))
            for line in lines:
                yield pa.RecordBatch.from_arrays([pa.array([line], pa.binary())], names=["records"])

    return run


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "warc_date", "record_id"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for raw in batch.column(0):
            rows = []
            for r in read_warc(io.BufferedReader(_Unzipped(raw.as_buffer().to_pybytes()), 1 << 18)):
                kind, told = r.get("WARC-Type"), (r.get("WARC-Payload-Digest") or "").partition(":")[2]
                if kind != "revisit" and told != digest(r.payload):
                    raise ValueError(f"payload digest of {r.get('WARC-Record-ID')} doesn't hold")
                number = lambda name, r=r: int(v) if (v := r.get(name)) is not None else None
                size = number("X-Payload-Length") if kind == "revisit" else len(r.payload)
                rows.append((number("X-Key"), size, told, kind, number("X-Refers-To-Key"), r.get("WARC-Target-URI"), r.get("WARC-Date"), r.get("WARC-Record-ID")))
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


READ_SCHEMA = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string"


def write_archives(df: DataFrame, path: str, key_col: str, url_col: str, payload_col: str, min_bytes: int = 0, date: str = "20000101000000", version: int = 1) -> None:
    """Rows through ARC into gzipped WARC files under ``path``.

    The response of each payload is settled first, on digests alone: only digests that repeat are kept,
    so what joins the payloads is small, and where it isn't, both sides shuffle by digest and Spark may
    split a hot one.  Spark's own text writer commits the files, so a lost executor's task is just rerun.
    """
    small_batches(df.sparkSession)
    rows = df.select(id_key(key_col).alias("key"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    repeated = Table(
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first"),
        "warc-repeated",
    )
    first = F.when(F.octet_length("payload") >= min_bytes, F.col("first"))
    records = rows.join(repeated.small(), "sha1", "left").select("key", first.alias("first"), "url", "payload").mapInArrow(_to_warc(date, version), "records binary")
    # bytes cast to string are not changed, and the line separator is the end of a WARC record
    (
        records.select(F.col("records").cast("string").alias("value"))
        .write.mode("overwrite").option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", LINES_PER_FILE).text(path)
    )
    repeated.drop()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record under ``path``, payload digests checked."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_from_warc, READ_SCHEMA)


def convert_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of ARC files (.arc or .arc.gz) under ``path``: the WARC record's headers and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for arc in read_arc(raw.as_buffer().to_pybytes()):
                    w = convert(arc)
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, w.get("WARC-Type"), w.get("WARC-Record-ID"), w.get("WARC-Date"), arc.url, w.get("WARC-Payload-Digest"), w.to_bytes())], names=["path", "record_type", "record_id", "warc_date", "url", "payload_digest", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, record_type string, record_id string, warc_date string, url string, payload_digest string, record binary")


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: pages through ARC into WARC archives in the shared folder, and back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    return read_archives(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", real_id("refers_to").alias("refers_to"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, (i // 4)::INT * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
