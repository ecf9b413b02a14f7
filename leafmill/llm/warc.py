"""WARC archives: a Python data source, format "warc", that writes and reads them.

Reading plans one partition for each file, takes filters on record type and other headers from Spark, and parses a
record's headers before its payload: what the filters reject, or what no column asks for, is skipped, not decoded.
Records are gzip members of their own. Those that this writer makes carry their compressed length in the member's
extra field ("sl"), so that a reader can seek past one after inflating its headers only.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from leafmill.llm.common import beside, shared_dir

LEAST = 100
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
MANIFEST = "_manifest.json"


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


def member(record: bytes, level: int = 4) -> bytes:
    """A gzip member with its own length in the extra field."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + bytes(6)
    extra = b"sl" + struct.pack("<HII", 8, len(head) + 2 + 12 + len(body), len(record) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body


def record(kind: str, headers: dict[str, str], payload: bytes) -> bytes:
    """A WARC 1.1 record; responses and revisits hold an HTTP header, then the payload."""
    block = payload
    if kind in ("response", "revisit"):
        headers = headers | {"Content-Type": "application/http; msgtype=response"}
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceWriter):
    """Rows as by SCHEMA into one archive a task; a manifest of the archives is what makes them count."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        fs, at = _fs(self.path)
        fs.create_dir(at, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with fs.open_output_stream(f"{at}/{name}", compression=None) as out:
            for r in rows:
                headers = {"WARC-Record-ID": r.record_id, "WARC-Date": "1970-01-01T00:00:00Z"}
                for key, value in (("WARC-Target-URI", r.target_uri), ("WARC-Refers-To", r.refers_to), ("WARC-Payload-Digest", r.payload_digest)):
                    if value is not None:
                        headers[key] = value.replace("\r", " ").replace("\n", " ")
                headers |= {k: v for k, v in (r.headers or {}).items() if v is not None}
                out.write(member(record(r.record_type, headers, bytes(r.payload or b""))))
        return Written(name)

    def commit(self, messages: list) -> None:
        fs, at = _fs(self.path)
        names = [m.name for m in messages if m is not None]
        if not self.overwrite and fs.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.File:
            names = json.loads(fs.open_input_file(f"{at}/{MANIFEST}").read()) + names
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{MANIFEST}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list) -> None:
        fs, at = _fs(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{at}/{m.name}")


class Bytes:
    """A buffered stream that can peek and skip."""

    def __init__(self, raw, size: int = 1 << 18):
        self.raw, self.size, self.buf, self.at, self.start = raw, size, b"", 0, 0

    def need(self, n: int) -> bool:
        """Whether n bytes can be had from here."""
        while len(self.buf) - self.at < n:
            more = self.raw.read(max(self.size, n))
            if not more:
                return False
            self.start += self.at
            self.buf, self.at = self.buf[self.at :] + more, 0
        return True

    def peek(self, n: int) -> bytes:
        self.need(n)
        return self.buf[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def skip(self, n: int) -> None:
        inside = min(n, len(self.buf) - self.at)
        self.at += inside
        if n > inside:
            where = self.start + self.at + n - inside
            self.raw.seek(where)
            self.buf, self.at, self.start = b"", 0, where


class Inflated:
    """The bytes of one gzip member, as far as they are asked for."""

    def __init__(self, source: Bytes):
        self.source, self.z, self.out = source, zlib.decompressobj(31), bytearray()

    def need(self, n: int) -> bool:
        while len(self.out) < n and not self.z.eof:
            if not self.source.need(1):
                break
            piece = self.source.take(min(1 << 14, len(self.source.buf) - self.source.at))
            self.out += self.z.decompress(piece)
            self.source.at -= len(self.z.unused_data)
        return len(self.out) >= n

    def drain(self) -> None:
        while not self.z.eof and self.source.need(1):
            piece = self.source.take(min(1 << 14, len(self.source.buf) - self.source.at))
            self.z.decompress(piece)
            self.source.at -= len(self.z.unused_data)


def _headers(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def records(raw, wants=lambda headers: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers and block of each record that `wants` its headers; blocks of others, and without `payload` all, are skipped."""
    stream = Bytes(raw)
    while stream.need(1):
        if stream.peek(2) == b"\x1f\x8b":
            begin, length = stream.start + stream.at, 0
            head = stream.peek(24)
            if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
                length = struct.unpack("<I", head[16:20])[0]
            inner = Inflated(stream)
            n = 1 << 12
            while (end := inner.out.find(b"\r\n\r\n")) < 0 and inner.need(n):
                n += 1 << 12
            if end < 0:
                end = inner.out.find(b"\r\n\r\n")
            if end < 0:
                raise ValueError("a gzip member without WARC headers")
            headers = _headers(bytes(inner.out[:end]))
            if wants(headers):
                size = int(headers.get("content-length", 0))
                block = None
                if payload:
                    if not inner.need(end + 4 + size):
                        raise ValueError("a record is cut short")
                    block = bytes(inner.out[end + 4 : end + 4 + size])
                yield headers, block
            now = stream.start + stream.at
            if length and begin + length >= now:
                stream.skip(begin + length - now)
            else:
                inner.drain()
        else:
            n = 1 << 12
            while (end := stream.peek(n).find(b"\r\n\r\n")) < 0:
                if not stream.need(n):
                    if stream.peek(n).strip():
                        raise ValueError("a record is cut short")
                    return
                n *= 2
            headers = _headers(stream.take(end + 4)[:end].lstrip())
            size = int(headers.get("content-length", 0))
            if wants(headers):
                yield headers, stream.take(size) if payload else None
                stream.skip(4 if payload else size + 4)
            else:
                stream.skip(size + 4)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block, without its HTTP header if it has one."""
    if headers.get("content-type", "").startswith("application/http") and (end := block.find(b"\r\n\r\n")) >= 0:
        return block[end + 4 :]
    return block


@dataclass
class File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    """Option path: an archive or a folder; option payload: "false" leaves payloads out without decoding them."""

    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.equal, self.among = path, payload, {}, {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Equality and IN on columns that are headers are tested on the headers; Spark keeps the others."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in COLUMNS:
                self.equal.setdefault(COLUMNS[f.attribute[0]], []).append(f.value)
            elif isinstance(f, In) and len(f.attribute) == 1 and f.attribute[0] in COLUMNS:
                self.among.setdefault(COLUMNS[f.attribute[0]], []).append(set(f.value))
            else:
                yield f

    def partitions(self) -> list[File]:
        fs, at = _fs(self.path)
        if fs.get_file_info(at).type == pafs.FileType.File:
            return [File(self.path)]
        base = self.path.rstrip("/")
        if fs.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.File:
            return [File(f"{base}/{n}") for n in json.loads(fs.open_input_file(f"{at}/{MANIFEST}").read())] or [File("")]
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True, allow_not_found=True))
        return [File(f"{base}/{os.path.relpath(x.path, at)}") for x in found if x.path.endswith((".warc", ".warc.gz"))] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, at = _fs(partition.path)
        wants = lambda h: all(h.get(k) in v and len(set(v)) == 1 for k, v in self.equal.items()) and all(h.get(k) in s for k, v in self.among.items() for s in v)
        kinds = [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        rows, held = [], 0
        with fs.open_input_file(at) as raw:
            for h, block in records(raw, wants, self.payload):
                body = None if block is None else payload_of(h, block)
                rows.append((*(h.get(k) for k in COLUMNS.values()), None if body is None else len(body), list(h.items()), body))
                held += len(body or b"")
                if len(rows) >= 2000 or held > 4 << 20:
                    yield pack(rows)
                    rows, held = [], 0
        if rows:
            yield pack(rows)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes a record for each page (page_id, url, html) into archives under `path`.

    Of pages with equal payloads of at least `least` bytes that with the smallest page_id is the response and the
    others revisit it; smaller ones are responses. Null html is an empty payload; a null url is left out; pages with a
    null id are responses that none revisits. Of equal ids with equal payloads one is the response. Ids and digests
    decide, without the payloads, which meet the decision by id: equal payloads are dealt over all tasks.
    """
    register(pages.sparkSession)
    body = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body"), F.sha2(body, 256).alias("digest"), F.length(body).cast("long").alias("size"))
    ids = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("page_id", "digest").agg(F.count("*").alias("rows"))
    shared = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = beside(ids, shared, "digest", "page_id").where("first < page_id").select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "first")
    named = rows.where("page_id is not null")
    told = named.join(later, (named["page_id"] == later["id"]) & (named["digest"] == later["of"]), "left").select(*rows.columns, "first")
    told = told.union(rows.where("page_id is null").withColumn("first", F.lit(None).cast(pages.schema["page_id"].dataType)))
    again = F.col("first").isNotNull()
    urn = lambda x: F.concat(F.lit("<urn:x-page:"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    extra = F.create_map(F.lit("X-Payload-Length"), F.col("size").cast("string"), F.lit("WARC-Profile"), F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))
    out = told.select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
        extra.alias("headers"),
        F.when(again, F.lit(None)).otherwise(F.col("body")).cast("binary").alias("payload"),
    )
    out.write.format("warc").option("path", path).mode("overwrite").save()


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record under `path`.

    A response's size and digest are taken from its payload as read; of revisits only headers are read.
    """
    register(spark)
    page = lambda c: F.regexp_extract(c, r"<urn:x-page:(-?\d+)>", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    full = spark.read.format("warc").option("path", path).load().where("record_type = 'response'")
    rest = spark.read.format("warc").option("path", path).option("payload", "false").load().where("record_type = 'revisit'")
    a = full.select(number("record_id").alias("page_id"), "payload_bytes", F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    b = rest.select(number("record_id").alias("page_id"), F.col("headers")["x-payload-length"].cast("long").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return a.union(b)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives the pages under the shared folder and reads the archives back: a row for each page.

    Nulls, equal ids and small payloads are treated as by archive(); other columns are not read.
    """
    path = f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive(pages, path)
    return read_back(pages.sparkSession, path)


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
