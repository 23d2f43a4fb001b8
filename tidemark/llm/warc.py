"""Legacy archives to WARC: ARC records are parsed by their version's header line and declared length, and written anew.

An ARC file starts with a version block that names the fields of its header lines, five in version 1 and ten in version
2; every record is a header line and as many bytes as it declares. The converter synthesises from these a record
identifier, an ISO timestamp, the record type and digests. Of records with equal payloads, that with the largest page id
is a response and the others revisit it by reference.

Archives are written by Spark's own text writer with the WARC record separator as line end, so they may lie in any store
and commit like any other output, and are read back as binary files, each streamed record by record.

A null html is an empty payload. A null page_id is archived as a response or, if a page with an id has the payload, as a
revisit, and comes back null. Rows that repeat the largest page_id of a payload are each a response. Blanks and control
characters of a URL are percent-encoded in header lines; a null URL becomes `-`. An empty table makes empty archives.
"""

from __future__ import annotations

import gzip
import io
import uuid
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, lean, small_side, written

#: Names of the header line's fields by version of the format (fixed values).
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
SEPARATOR = "\r\n\r\n"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes
    version: int = 1


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def quoted(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or "-"


def write_arc(records: list[tuple[str | None, str, str, bytes]], version: int = 1, date: str = "20200101000000") -> bytes:
    """An ARC file of (url, 14-digit date, content type, content)."""
    names = " ".join(FIELDS[version])
    about = f"{version} 0 archive\n{names}\n".encode()

    def line(url: str, ip: str, when: str, kind: str, length: int) -> bytes:
        middle = "" if version == 1 else "200 - - 0 archive.arc "
        return f"{url} {ip} {when} {kind} {middle}{length}\n".encode()

    out = [line("filedesc://archive.arc", "0.0.0.0", date, "text/plain", len(about)), about, b"\n"]
    for url, when, kind, content in records:
        out += [line(quoted(url), "0.0.0.0", when, kind, len(content)), content, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block left out. Raises ValueError where it breaks its own declarations."""
    at, version, names = 0, 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError("header line without end")
        parts = data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(parts[-1]) if parts[-1].isdigit() else -1
        content = data[stop + 1 : stop + 1 + length]
        if length < 0 or len(content) < length:
            raise ValueError("declared length missing or beyond the end")
        at = stop + 1 + length
        if not version:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("no version block")
            head = content.split(b"\n")
            version = int(head[0].split(b" ")[0])
            names = tuple(head[1].decode().split()) if len(head) > 1 and head[1].strip() else FIELDS[version]
            continue
        if len(parts) != len(names):
            raise ValueError(f"{len(parts)} fields in a header line of version {version}")
        yield ArcRecord(dict(zip(names, parts, strict=True)), content, version)


def digest(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, row: int | None = None) -> str:
    """A name-based identifier: the same record gets it again after a lost task. row tells rows of a page apart that aren't its first."""
    name = f"{page_id} {payload_digest}" if row is None else f"{page_id} {payload_digest} {row}"
    return f"<urn:uuid:{uuid.UUID(bytes=sha1(name.encode()).digest()[:16], version=5)}>"


def timestamp(date: str) -> str:
    """14 digits, or fewer filled up, as an ISO instant."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def converted(arc: ArcRecord, page_id: int | None, refers_to: int | None, row: int | None = None) -> WarcRecord:
    """The WARC record of an ARC record; a revisit keeps the head of the response and drops its payload."""
    head, _, payload = arc.content.partition(SEPARATOR.encode())
    block = head + SEPARATOR.encode() + (payload if refers_to is None else b"")
    payload_digest = digest(payload)
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, payload_digest, row),
        "WARC-Date": timestamp(arc.fields["Archive-date"]),
        "WARC-Target-URI": arc.fields["URL"],
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "X-Page-Id": "" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, payload_digest), "X-Refers-To-Page-Id": str(refers_to)}
    return WarcRecord(headers | {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}, block)


def serialised(record: WarcRecord) -> bytes:
    """A record without the two line ends behind it."""
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in record.headers.items()).encode() + b"\r\n" + record.block


def read_warc(stream: io.BufferedIOBase) -> Iterator[WarcRecord]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should start")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("declared length beyond the end")
        yield WarcRecord(headers, block)


def archived(pages: DataFrame, path: str, least: int = 0, version: int = 1, date: str = "20200101000000") -> None:
    """Write pages (page_id, url, html) to WARC files under path. Payloads of fewer than least bytes never revisit."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    key = F.sha1(F.encode("html", "UTF-8"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    copies = rows.where(F.octet_length("html") >= least).groupBy(key.alias("key")).agg(F.max("page_id").alias("original"), F.max_by("row", "page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= least, key)).join(small_side(written(copies, "copies")), "key", "left")
    refers = F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))

    # the record that others refer to goes by its page and payload alone, unless rows repeat it
    first = F.col("page_id").isNotNull() & (F.col("row") == F.col("first"))
    row = F.when(~F.coalesce(first, F.col("page_id").isNotNull() & F.col("key").isNotNull() & F.col("original").isNull()), F.col("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nconformsTo: ARC version {version}\r\n".encode()
        head = WarcRecord({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(bytes=sha1(about).digest()[:16], version=5)}>", "WARC-Date": timestamp(date), "Content-Type": "application/warc-fields", "Content-Length": str(len(about))}, about)
        yield pa.RecordBatch.from_arrays([pa.array([serialised(head).decode()])], ["value"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                contents = []
                for html in part.column(2).to_pylist():
                    body = html.encode()
                    contents.append(b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body)
                arc = write_arc([(u, date, "text/html", c) for u, c in zip(part.column(1).to_pylist(), contents, strict=True)], version, date)
                out = [serialised(converted(r, i, o, n)).decode() for r, i, o, n in zip(read_arc(arc), *(part.column(c).to_pylist() for c in (0, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.large_string()).cast(pa.string())], ["value"])

    records = rows.select("page_id", "url", "html", refers.alias("refers_to"), row.alias("row")).mapInArrow(lean(run), "value string")
    records.write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)


def restored(spark, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the WARC records under path.

    The digest of a response is computed from what was read and must be the declared one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                for r in read_warc(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    kind = r.headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = r.block.partition(SEPARATOR.encode())
                    declared = r.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if kind == "response" and (digest(payload) != declared or len(payload) != size):
                        raise ValueError(f"payload of {r.headers['WARC-Record-ID']} isn't the declared one")
                    page, other = r.headers["X-Page-Id"], r.headers.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, r.headers["WARC-Target-URI"], size, declared, kind, int(other) if other else None))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(lean(run), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive pages in the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    archived(pages, path, least)
    return restored(spark, path)
