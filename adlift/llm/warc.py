"""WARC archives as a PySpark Python data source (``format("warc")``).

Writing: one gzip member per record, its compressed and plain sizes in the
member's extra field (``sl``), so a reader can step over a record without
inflating it.  Each task writes a file of its own name; the driver's commit
writes a manifest of the files and split points that succeeded, so repeated or
lost attempts leave nothing in the result.

Reading: partitions are planned from the manifest (split points about
``SPLIT_BYTES`` apart; without a manifest, one partition per archive, foreign
``.warc`` and ``.warc.gz`` included).  Filters on record type and headers are
pushed into the reader; only the start of a member is inflated to parse its
headers, and the payload of an unwanted record - or of every record with option
``payload=false`` - is never inflated.

Edge cases: a null payload is an empty one; a null target_uri has no header and
reads back as null; CR and LF in header values are percent-encoded; no rows give
a manifest without files, which reads back as an empty table.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from adlift.llm.tokenstore import _uri

SPLIT_BYTES = 8 << 20
HEAD_BYTES = 2048
READ_BYTES = 1 << 20
MIN_DEDUP_BYTES = 100
DATE = "2000-01-01T00:00:00Z"  # records carry a fixed date unless the input has one
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
          "payload_length long, content_length long, payload binary")
HEADERS = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length", "content_length"]


def _clean(v: str) -> str:
    return v.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(record_id, record_type, target_uri, refers_to, digest, length, payload) -> bytes:
    """Plain bytes of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if record_type != "revisit" else b"")
    head = ["WARC/1.1", f"WARC-Type: {_clean(record_type)}", f"WARC-Record-ID: <{_clean(record_id)}>", f"WARC-Date: {DATE}"]
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {_clean(target_uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_clean(refers_to)}>", f"WARC-Profile: {REVISIT}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(plain: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``sl`` holds (member bytes, plain bytes)."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(plain) + c.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF))


def parse_headers(head: bytes) -> dict:
    """Named header fields of a record (``head`` ends before the blank line)."""
    out: dict = dict.fromkeys(HEADERS)
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, v = line.partition(":")
        name, v = name.strip().lower(), v.strip()
        if name == "warc-type":
            out["record_type"] = v
        elif name == "warc-record-id":
            out["record_id"] = v.strip("<>")
        elif name == "warc-target-uri":
            out["target_uri"] = v
        elif name == "warc-refers-to":
            out["refers_to"] = v.strip("<>")
        elif name == "warc-payload-digest":
            out["payload_digest"] = v.partition(":")[2] or v
        elif name == "content-length":
            out["content_length"] = int(v)
    return out


@dataclass
class WarcCommit(WriterCommitMessage):
    file: str | None
    size: int
    splits: list[int]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = _uri(folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcCommit:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        name, out, size, splits = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, [0]
        for b in iterator:
            cols = [b.column(c).to_pylist() for c in ("record_id", "record_type", "target_uri", "refers_to",
                                                       "payload_digest", "payload_length", "payload")]
            for rid, kind, uri, ref, digest, length, payload in zip(*cols, strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                if size - splits[-1] >= SPLIT_BYTES:
                    splits.append(size)
                m = gzip_member(encode_record(rid, kind, uri, ref, digest, length or 0, payload or b""))
                out.write(m)
                size += len(m)
        if out is None:
            return WarcCommit(None, 0, [])
        out.close()
        return WarcCommit(name, size, splits)

    def commit(self, messages: list[WarcCommit | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        fs.create_dir(root, recursive=True)
        files = [{"file": m.file, "size": m.size, "splits": m.splits} for m in messages if m and m.file]
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[WarcCommit | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m and m.file:
                fs.delete_file(f"{root}/{m.file}")


@dataclass
class WarcPartition(InputPartition):
    path: str
    start: int
    end: int | None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = _uri(options["path"])
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Header predicates are kept; the others go back to Spark."""
        kinds = (EqualTo, In, StringStartsWith, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)
        for f in filters:
            column = getattr(f, "attribute", ())
            name = column[0] if len(column) == 1 else None
            # payload_length comes from the HTTP head behind the WARC headers: parsed with the payload
            if isinstance(f, kinds) and name in HEADERS and name != "payload_length":
                self.filters.append(f)
            else:
                yield f

    def wanted(self, h: dict) -> bool:
        for f in self.filters:
            v = h[f.attribute[0]]
            if v is None:
                return False
            if isinstance(f, EqualTo) and v != f.value or isinstance(f, In) and v not in f.value \
                    or isinstance(f, StringStartsWith) and not v.startswith(f.value) \
                    or isinstance(f, GreaterThan) and not v > f.value \
                    or isinstance(f, GreaterThanOrEqual) and not v >= f.value \
                    or isinstance(f, LessThan) and not v < f.value \
                    or isinstance(f, LessThanOrEqual) and not v <= f.value:
                return False
        return True

    def partitions(self) -> list[WarcPartition]:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        names = {i.base_name: i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file}
        found = [n for n in sorted(names) if n.startswith("_manifest-")]
        if not found:
            return [WarcPartition(names[n], 0, None) for n in sorted(names) if n.endswith((".warc", ".warc.gz"))]
        out = []
        for n in found:
            with fs.open_input_file(names[n]) as f:
                files = json.loads(f.readall())
            for x in files:
                ends = [*x["splits"][1:], x["size"]]
                out += [WarcPartition(f"{root}/{x['file']}", a, b) for a, b in zip(x["splits"], ends, strict=True)]
        return out or [WarcPartition("", 0, 0)]

    def read(self, partition: WarcPartition):
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(partition.path) as f:
            end = f.size() if partition.end is None else partition.end
            gz = partition.path.endswith(".gz")
            records = (self._members if gz else self._plain)(_Window(f, partition.start, end))
            rows: list[dict] = []
            size = 0
            for h, payload in records:
                rows.append(h | {"payload": payload})
                size += len(payload or b"") + 500
                if size > 4 << 20:
                    yield self._batch(rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_length": pa.int64(), "content_length": pa.int64(), "payload": pa.binary()}
        names = [*HEADERS, "payload"]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    def _finish(self, h: dict, block: bytes | None) -> tuple[dict, bytes | None]:
        """Split HTTP head and payload of a wanted record."""
        if block is None:
            return h, None
        head, sep, payload = block.partition(b"\r\n\r\n")
        if not (sep and head.startswith(b"HTTP/")):
            head, payload = b"", block
        for line in head.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                h["payload_length"] = int(line.partition(b":")[2])
        if h["payload_length"] is None:
            h["payload_length"] = len(payload)
        return h, payload if self.payload and h["record_type"] != "revisit" else None

    def _members(self, w: _Window):
        while w.more():
            head = w.peek(12)
            flags, extra = head[3], struct.unpack("<H", head[10:12])[0] if head[3] & 4 else 0
            field = w.peek(12 + extra)[12:] if flags & 4 else b""
            size = struct.unpack("<I", field[4:8])[0] if field[:4] == b"sl\x08\x00" and flags == 4 else 0
            if size:
                # headers first: inflate only the start of the member
                z, first = zlib.decompressobj(-15), w.peek(min(size, 12 + extra + HEAD_BYTES))[12 + extra:]
                plain = z.decompress(first, HEAD_BYTES)
                while b"\r\n\r\n" not in plain and len(plain) >= HEAD_BYTES and not z.eof:
                    plain += z.decompress(z.unconsumed_tail or w.peek(size)[12 + extra:][len(first):], 1 << 16)
                if b"\r\n\r\n" not in plain:
                    plain = zlib.decompress(w.peek(size), 31)
                h = parse_headers(plain.partition(b"\r\n\r\n")[0])
                if self.wanted(h):
                    if self.payload or h["record_type"] == "revisit":
                        plain = zlib.decompress(w.peek(size), 31)
                    body = plain.partition(b"\r\n\r\n")[2]
                    yield self._finish(h, body[:h["content_length"] or 0])
                w.skip(size)
            else:
                z, plain = zlib.decompressobj(31), b""
                while not z.eof and w.more():
                    block = w.take(READ_BYTES)
                    plain += z.decompress(block)
                    if z.eof:
                        w.give_back(z.unused_data)
                head, _, body = plain.partition(b"\r\n\r\n")
                h = parse_headers(head)
                if self.wanted(h):
                    yield self._finish(h, body[:h["content_length"] or 0])

    def _plain(self, w: _Window):
        while w.more():
            n = HEAD_BYTES
            while b"\r\n\r\n" not in (head := w.peek(n)) and len(head) == n:
                n *= 2
            text, sep, _ = head.partition(b"\r\n\r\n")
            if not sep:
                return
            w.skip(len(text) + 4)
            h = parse_headers(text)
            size = h["content_length"] or 0
            if self.wanted(h):
                yield self._finish(h, w.take(size))
            else:
                w.skip(size)
            w.skip(4)


class _Window:
    """Buffered bytes of a file range; skipping past the buffer seeks."""

    def __init__(self, f, start: int, end: int) -> None:
        self.f, self.pos, self.end, self.buf = f, start, end, b""

    def more(self) -> bool:
        return self.pos < self.end

    def peek(self, n: int) -> bytes:
        n = min(n, self.end - self.pos)
        if len(self.buf) < n:
            self.f.seek(self.pos + len(self.buf))
            self.buf += self.f.read(min(max(n, READ_BYTES), self.end - self.pos) - len(self.buf))
        return self.buf[:n]

    def skip(self, n: int) -> None:
        self.buf, self.pos = self.buf[n:], self.pos + n

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.skip(len(out))
        return out

    def give_back(self, data: bytes) -> None:
        self.buf, self.pos = data + self.buf, self.pos - len(data)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known and let Spark push filters into Python sources."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(pages: DataFrame, key: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """Records of pages: of equal payloads of at least ``MIN_DEDUP_BYTES`` bytes the
    smallest key is the response, the others revisit it."""
    p = pages.select(F.col(key).cast("long").alias("k"), F.col(uri).cast("string").alias("target_uri"),
                     F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_length", F.octet_length("payload").cast("long")) \
        .withColumn("payload_digest", F.sha2("payload", 256))
    twice = p.where(F.col("payload_length") >= MIN_DEDUP_BYTES).groupBy(F.col("payload_digest").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).where("n > 1").select("d", "first")
    j = p.join(twice, F.col("payload_digest") == F.col("d"), "left")
    again = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    rid = F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("k").cast("string"), F.lit("none")))
    return j.select(rid.alias("record_id"), F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
                    "target_uri", F.when(again, F.concat(F.lit("urn:x-page:"), F.col("first").cast("string"))).alias("refers_to"),
                    "payload_digest", "payload_length", F.lit(None).cast("long").alias("content_length"),
                    F.when(~again, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, folder: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("path", folder).save()


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", folder).option("payload", str(payload).lower()).load()
