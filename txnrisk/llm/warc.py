"""WARC archives: a writer that stores equal payloads once, and a Python data source that reads headers first.

Reading plans partitions from whole files. Predicates on the record type and on headers are pushed into the source; a record that
they reject is skipped by its length, before its payload is decompressed or decoded. Archives are gzip members, one a
record, with the compressed length in the member's extra field ("sl"), or plain files; foreign gzip files without that
field are read as a stream.

Files are opened through Arrow's file systems, by the URI of the shared folder. Written files have random names and count only if the
manifest of the finished write names them, so lost or repeated attempts do no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import table
from txnrisk.session import run_folder

# Names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: gzip header with an extra field: magic, method, flags, time, system; then its length, "sl", 8, compressed and plain length
_MEMBER = struct.Struct("<4sIBBH2sHII")
_GZIP = b"\x1f\x8b\x08\x04"

#: A file is closed beyond this size; files are packed into read partitions of this size.
FILE_BYTES = 64 << 20
ROWS_A_BATCH = 1_000

HEADER_COLUMNS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to_id": "WARC-Refers-To",
}
RECORDS = T.StructType([*(T.StructField(c, T.StringType()) for c in HEADER_COLUMNS), T.StructField("payload_bytes", T.LongType())])
WRITTEN = T.StructType([T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none:{salt}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value: str) -> bytes:
    # A header is one line: line breaks of a URL are escaped.
    return f"{name}: {value.replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n".encode("utf-8", "surrogatepass")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit (refers_to given) holds the HTTP headers without the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers_to is not None else head + payload
    lines = [VERSION + b"\r\n", _line("WARC-Type", "response" if refers_to is None else "revisit")]
    lines.append(_line("WARC-Record-ID", record_id(page_id, uuid.uuid4().hex if page_id is None else "")))
    lines.append(_line("WARC-Date", date))
    if url is not None:
        lines.append(_line("WARC-Target-URI", url))
    lines.append(_line("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if refers_to is not None:
        lines += [_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", record_id(refers_to))]
    lines += [_line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", str(len(body))), b"\r\n"]
    return b"".join([*lines, body, b"\r\n\r\n"])


def gzip_member(data: bytes, level: int = 1) -> bytes:
    """A gzip member that tells its own length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = deflate.compress(data) + deflate.flush()
    total = _MEMBER.size + len(packed) + 8
    return _MEMBER.pack(_GZIP, 0, 0, 255, 12, b"sl", 8, total, len(data)) + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


# ---------------------------------------------------------------- reading


def _headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


class _Plain:
    """Records of a stream without compression, or of one that is decompressed as it is read."""

    def __init__(self, stream, skips: bool):
        self.stream, self.skips = stream, skips

    def __iter__(self) -> Iterator[tuple[dict[str, str], _Plain]]:
        while line := self.stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            lines = []
            while (line := self.stream.readline()).strip():
                lines.append(line)
            headers = _headers(lines)
            self.left = int(headers.get("content-length", 0))
            yield headers, self
            if self.left:
                self.take(self.left, keep=False)

    def line(self) -> bytes:
        got = self.stream.readline(self.left)
        self.left -= len(got)
        return got

    def take(self, n: int, keep: bool = True) -> bytes:
        self.left -= n
        if keep:
            return self.stream.read(n)
        if self.skips:
            self.stream.seek(n, io.SEEK_CUR)
        else:
            while n > 0 and (got := self.stream.read(min(n, 1 << 20))):
                n -= len(got)
        return b""


class _Members:
    """Records of gzip members that tell their length: of a record that nobody reads only the start is decompressed."""

    START = 1 << 12

    def __init__(self, stream):
        self.stream = stream

    def __iter__(self) -> Iterator[tuple[dict[str, str], _Members]]:
        while head := self.stream.read(_MEMBER.size):
            total = _MEMBER.unpack(head)[7]
            self.packed = self.stream.read(total - _MEMBER.size - 8)
            self.stream.seek(8, io.SEEK_CUR)
            self.inflate, self.fed, self.data, self.at = zlib.decompressobj(-15), 0, b"", 0
            if not self.line().startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            lines = []
            while (line := self.line()).strip():
                lines.append(line)
            headers = _headers(lines)
            self.left = int(headers.get("content-length", 0))
            yield headers, self

    def _more(self, n: int) -> bool:
        if self.fed >= len(self.packed):
            return False
        self.data = self.data[self.at :] + self.inflate.decompress(self.packed[self.fed : self.fed + n])
        self.at, self.fed = 0, self.fed + n
        return True

    def line(self) -> bytes:
        while (end := self.data.find(b"\n", self.at)) < 0:
            if not self._more(self.START):
                end = len(self.data) - 1
                break
        line = self.data[self.at : end + 1]
        self.at = end + 1
        return line

    def take(self, n: int, keep: bool = True) -> bytes:
        if not keep:
            return b""
        while len(self.data) - self.at < n and self._more(len(self.packed)):
            pass
        out = self.data[self.at : self.at + n]
        self.at += n
        return out


def _records(stream):
    start = stream.peek(_MEMBER.size)[: _MEMBER.size]
    if start[:4] == _GZIP and len(start) == _MEMBER.size and start[12:14] == b"sl":
        return _Members(stream)
    if start[:2] == b"\x1f\x8b":
        return _Plain(io.BufferedReader(gzip.GzipFile(fileobj=stream)), skips=False)
    return _Plain(stream, skips=True)


def _passes(headers: dict[str, str], tests: list[tuple[str, str, object]]) -> bool:
    for column, kind, value in tests:
        own = _column(headers, column)
        if kind == "equal" and own != value or kind == "in" and own not in value or kind == "starts" and not (own or "").startswith(value) or kind == "known" and own is None:
            return False
    return True


def _column(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADER_COLUMNS[column].lower())
    return value.removeprefix("sha1:") if value and column == "payload_digest" else value


def read_file(path: str, tests: list[tuple[str, str, object]], payload: bool, verify: bool) -> Iterator[list]:
    """Rows of the records of a file that pass the tests on their headers: header columns, payload bytes[, payload]."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as raw, io.BufferedReader(raw, 1 << 20) as stream:
        for headers, body in _records(stream):
            if not _passes(headers, tests):
                continue
            row = [_column(headers, c) for c in HEADER_COLUMNS]
            length = int(headers.get("content-length", 0))
            http = {}
            if headers.get("content-type", "").startswith("application/http"):
                lines = []
                while line := body.line():
                    length -= len(line)
                    if not line.strip():
                        break
                    lines.append(line)
                http = _headers(lines[1:])
            revisit = row[0] == "revisit"
            data = None
            if (payload or verify) and not revisit:
                data = body.take(length)
                if verify and row[4] is not None and digest(data) != row[4]:
                    raise ValueError(f"payload of {row[1]} in {path} does not match its digest")
            size = int(http.get("content-length", 0)) if revisit else length if data is None else len(data)
            yield [*row, size, *([data] if payload else [])]


class WarcPartition(D.InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(D.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns, self.path = schema.fieldNames(), options["path"].rstrip("/")
        self.payload = "payload" in self.columns
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes the predicates that a record's headers decide."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = {D.EqualTo: "equal", D.In: "in", D.StringStartsWith: "starts", D.IsNotNull: "known"}.get(type(f))
            if column in HEADER_COLUMNS and kind:
                self.tests.append((column, kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        """Whole files, packed to FILE_BYTES; those that the manifest names, or all if there is none."""
        from pyarrow import fs
        from pyarrow import parquet as pq

        system, name = fs.FileSystem.from_uri(self.path)
        if system.get_file_info(name).type == fs.FileType.File:
            return [WarcPartition([self.path])]
        if system.get_file_info(f"{name}/manifest").type == fs.FileType.Directory:
            rows = pq.read_table(f"{name}/manifest", filesystem=system).to_pylist()
            found = sorted((r["file"], r["bytes"]) for r in rows)
        else:
            infos = system.get_file_info(fs.FileSelector(name, recursive=True))
            found = sorted((i.path.removeprefix(name).lstrip("/"), i.size) for i in infos if i.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path))
        packs, size = [], FILE_BYTES
        for file, n in found:
            if size + n > FILE_BYTES:
                packs.append([])
                size = 0
            packs[-1].append(f"{self.path}/{file}")
            size += n
        return [WarcPartition(p) for p in packs] or [WarcPartition([])]

    def read(self, partition):
        schema = pa.schema([pa.field(c, pa.binary() if c == "payload" else pa.int64() if c == "payload_bytes" else pa.string()) for c in [*HEADER_COLUMNS, "payload_bytes", *["payload"][: self.payload]]])
        rows, size = [], 0
        for path in partition.files:
            for row in read_file(path, self.tests, self.payload, self.verify):
                rows.append(row)
                size += row[6] if self.payload else 0
                if len(rows) == ROWS_A_BATCH or size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class WarcSource(D.DataSource):
    """format("warc"): one row per record. Options: path, payload (true adds a binary column), verify (true checks digests)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        extra = [T.StructField("payload", T.BinaryType())] if self.options.get("payload", "false").lower() == "true" else []
        return T.StructType([*RECORDS.fields, *extra])

    def reader(self, schema):
        return WarcReader(schema, dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: bool = False, verify: bool = False) -> DataFrame:
    """The records below a path: record_type, record_id, target_uri, warc_date, payload_digest, refers_to_id, payload_bytes[, payload].

    Filters on the header columns (=, IN, prefix, not null) run inside the source.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).option("verify", str(verify).lower()).load()


def page_of(record: F.Column) -> F.Column:
    """The page id of a record id, null if it has none."""
    return F.regexp_extract(record, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


# ---------------------------------------------------------------- writing


def first_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(copy_digest, first_page) of the payloads of at least min_bytes that several rows share."""
    payload = _payload()
    sums = pages.select("page_id", F.unhex(F.sha1(payload)).alias("copy_digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= min_bytes)
    return sums.groupBy("copy_digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies")).filter("copies > 1 and first_page is not null").drop("copies")


def _payload() -> F.Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", compress: bool = True) -> str:
    """Writes a record per row of pages (page_id, url, html) and returns the folder.

    The payload is html in UTF-8 (null: empty). Of rows with equal payloads of at least min_bytes, those with the smallest
    page_id are responses and the others revisit it; rows without a page_id are revisits of a page that has one, else
    responses. A null url has no target URI. Only digests are shuffled; pages meet the list of repeated payloads.
    """
    from txnrisk.session import materialise

    spark = pages.sparkSession
    folder = folder or run_folder(spark, "warc")
    copies = materialise(first_copies(pages, min_bytes), "warc-copies")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("payload"))
    marked = narrow.withColumn("own_digest", F.unhex(F.sha1("payload"))).join(copies, F.col("own_digest") == F.col("copy_digest"), "left")
    refers = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page"))
    rows = marked.select("page_id", "url", "payload", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(folder)
        system.create_dir(name, recursive=True)
        done, sink, file, size, count = [], None, "", 0, 0

        def close():
            sink.close()
            done.append((file, size, count))

        for batch in batches:
            for page, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    file, size, count = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0, 0
                    sink = system.open_output_stream(f"{name}/{file}", compression=None)
                data = record_bytes(page, url, payload, refers_to, date)
                data = gzip_member(data) if compress else data
                sink.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=WRITTEN.fieldNames())

    rows.mapInArrow(write, WRITTEN).write.parquet(f"{folder}/manifest")
    return folder


def op3_warc(spark, sf_dir):
    folder = write_warc(table(spark, sf_dir, "pages"), min_bytes=0)
    found = read_warc(spark, folder, verify=True).filter(F.col("record_type").isin("response", "revisit"))
    return found.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to_id")).alias("refers_to"))


QUERIES = {"op3_warc": op3_warc}

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex FROM p),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: right(bin(('0x' || substr(hex, i, 1))::INT + 16), 4)), '') AS bits FROM h),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('{_ALPHABET}', (list_sum(list_transform(range(0, 5), lambda j: substr(bits, i * 5 + j + 1, 1)::INT * (1 << (4 - j))))::INT) + 1, 1)), '') AS payload_digest FROM bits),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
""",
}
