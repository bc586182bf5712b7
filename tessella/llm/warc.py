"""WARC archives: written by Spark's text writer, read by a Python data source with header predicates.

A record's lines and payload are one string and records end in two CRLFs, so any file system Spark can write to will
do, and the writer's commit protocol keeps whole files only. The reader opens files with pyarrow's file systems
(local and shared folders, hdfs, s3, gs) in the executors' Python.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith

from tessella.storage import materialize, small

END = "\r\n"
RECORD = "record_id string, record_type string, target_uri string, record_date string, refers_to string, content_type string, payload_digest string, payload_length long, content_length long, payload binary"
_HEADERS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "record_date": "warc-date", "refers_to": "warc-refers-to",
    "content_type": "content-type", "payload_digest": "warc-payload-digest", "payload_length": "x-payload-length", "content_length": "content-length",
}
_NUMBERS = {"payload_length", "content_length"}
#: RFC 4648 base32 digits, and the digits 0-9A-V of base 32 in the same order. Fixed values.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
ID_PREFIX = "urn:tessella:page:"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hexadecimal digits are 4 digits of base 32."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), BASE32_PLAIN, BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Line breaks in a value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit(END)), F.lit(""))


def write_pages(pages: DataFrame, path: str, *, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, broadcast_rows: int = 200_000) -> None:
    """Write one record for each page (page_id, url, html) to WARC files under path; html in UTF-8 is the payload.

    Of records with equal payloads of at least least_bytes bytes, the one with the smallest page_id is a response and
    the others are revisits that refer to it and carry no payload; smaller payloads are all responses. Only the
    digests that occur with several page_ids (with one number each) meet the pages again: broadcast if a count proves
    them few, else by a shuffle on the digest.

    Nulls and odd input: a null html is an empty payload. A null page_id is a response if its payload has no other
    page_id, else a revisit; its record id ends in 'null'. Rows that repeat a page_id with the same payload have the
    same standing. A null url has no Target-URI line. Further columns are ignored; an empty table makes files
    without records.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    data = F.encode("html", "utf-8")
    size = F.octet_length("html").cast("long")
    keyed = raw.withColumn("digest", base32_sha1(data)).withColumn("size", size)
    shared = keyed.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    standing = keyed.join(small(materialize(shared, "shared"), broadcast_rows), "digest", "left")
    revisit = F.coalesce((F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    name = F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), _line("Content-Length", F.col("size")), F.lit(END))
    head = F.octet_length(http).cast("long")
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("size")),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit(f"<{ID_PREFIX}"), F.col("first").cast("string"), F.lit(">")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.when(revisit, head).otherwise(head + F.col("size"))),
        F.lit(END),
        http,
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    standing.select(record.alias("value")).write.option("lineSep", END * 2).text(path)


@dataclass
class FilePart(InputPartition):
    """Some whole files of one task."""

    files: list[str]


def _open(path: str):
    from pyarrow import fs

    scheme = urlparse(path).scheme
    system, inside = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if scheme else f"file://{path}")
    return system, inside


def read_records(stream, wants, columns: list[str]):
    """Records of an uncompressed WARC stream that pass `wants` (a test on the header map), as lists of columns.

    The headers are parsed first. The block of a record that is not wanted, or of which the payload is not asked for,
    is passed over by a seek. A record cut off in the middle is an error.
    """
    whole = "payload" in columns
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}")
        headers: dict[str, str] = {}
        last = None
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("a WARC record ends within its headers")
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.decode("utf-8", "replace").strip()
                continue
            key, _, value = line.decode("utf-8", "replace").partition(":")
            headers[last := key.strip().lower()] = value.strip()
        size = int(headers.get("content-length", 0))
        if not wants(headers):
            stream.seek(size, 1)
            continue
        payload = None
        if whole:
            block = stream.read(size)
            if len(block) < size:
                raise ValueError("a WARC record ends within its block")
            payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
        else:
            stream.seek(size, 1)
        yield [payload if c == "payload" else value_of(headers, c) for c in columns]


def value_of(headers: dict[str, str], column: str):
    """The value of a column from the headers, null if it is absent."""
    value = headers.get(_HEADERS[column])
    if value is None:
        return None
    if column in _NUMBERS:
        return int(value) if value.isdigit() else None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">")
    return value


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        if unknown := set(self.columns) - {*_HEADERS, "payload"}:
            raise ValueError(f"unknown WARC columns: {sorted(unknown)}")
        self.path = options["path"]
        self.part_bytes = int(options.get("partbytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes equality, membership, prefix and non-null tests on header columns; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", (f.value,)))
            elif isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append((column, "there", None))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, inside = _open(self.path)
        found = [x for x in system.get_file_info(fs.FileSelector(inside, recursive=True)) if x.type == fs.FileType.File and not x.base_name.startswith(("_", "."))]
        prefix = self.path[: self.path.rindex(inside)] if self.path.endswith(inside) else ""
        parts, size = [], 0
        for x in sorted(found, key=lambda x: (-x.size, x.path)):
            if not parts or size + x.size > self.part_bytes:
                parts.append(FilePart([]))
                size = 0
            parts[-1].files.append(prefix + x.path)
            size += x.size
        return parts or [FilePart([])]

    def read(self, partition):
        tests = self.tests

        def wants(headers) -> bool:
            for column, kind, value in tests:
                own = value_of(headers, column)
                if own is None or (kind == "in" and own not in value) or (kind == "starts" and not own.startswith(value)):
                    return False
            return True

        types = [pa.binary() if c == "payload" else pa.int64() if c in _NUMBERS else pa.string() for c in self.columns]
        schema = pa.schema(list(zip(self.columns, types, strict=True)))
        for path in partition.files:
            system, inside = _open(path)
            with system.open_input_file(inside) as raw:
                rows, size = [], 0
                for row in read_records(_buffered(raw), wants, self.columns):
                    rows.append(row)
                    size += len(row[self.columns.index("payload")] or b"") if "payload" in self.columns else 256
                    if size > 8 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _buffered(raw):
    """A buffered reader with readline and relative seeks over an Arrow file."""
    class Raw(io.RawIOBase):
        def readable(self):
            return True

        def seekable(self):
            return True

        def readinto(self, buffer):
            data = raw.read(len(buffer))
            buffer[: len(data)] = data
            return len(data)

        def seek(self, offset, whence=0):
            raw.seek(offset if whence == 0 else raw.tell() + offset if whence == 1 else raw.size() + offset)
            return raw.tell()

        def tell(self):
            return raw.tell()

    return io.BufferedReader(Raw(), 1 << 20)


class WarcSource(DataSource):
    """Format "warc". Options: path (a folder or file system URI), partBytes (bytes of files a task, default 64 MB).

    The columns are those of the schema given to the reader, any of RECORD's; payloads are decoded only if the schema
    has the column payload. Tests on header columns are pushed down.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, columns: str = RECORD) -> DataFrame:
    """The records under path with these columns; switches on spark.sql.python.filterPushdown.enabled, without which Spark refuses a reader that takes filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).load(path)
