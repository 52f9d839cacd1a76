"""Crawl files as a Spark data source: spark.read.format("webarchive").load(path).

One input partition holds whole files, since gzip can't be split; small files
share one up to `partitionBytes`. Paths may be on any file system that pyarrow
opens; folders are listed on the driver.
"""

from __future__ import annotations

import fnmatch
import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

from crawlspan.functions.text import content_string, extract_date, image_bytes
from crawlspan.functions.url import host
from crawlspan.session import ship
from crawlspan.sources import codec

NAMES = ["file", "format", "record_type", "url", "ip", "crawl_ts", "mime_type", "length", "headers", "content"]
SCHEMA = "file string, format string, record_type string, url string, ip string, crawl_ts timestamp, mime_type string, length bigint, headers map<string,string>, content binary"


@dataclass
class Files(InputPartition):
    paths: list[str]


def filesystem(path: str):
    """(file system, path in it) of a local path or a URI, also of one such as `file:/folder`."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, pattern: str = "*", recursive: bool = True) -> list[tuple[str, int]]:
    """(path, size) of the files under a path or glob."""
    from pyarrow import fs

    root = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    if "*" in root:
        root, _, last = root.rpartition("/")
        pattern = last
    system, inner = filesystem(root)
    scheme = root[: root.index("://") + 3] if "://" in root else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=recursive))
    return sorted((scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern) and x.base_name[:1] not in "._")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.equal: dict[str, str] = {}

    def partitions(self) -> list[Files]:
        names = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        limit = int(self.options.get("partitionbytes", 128 << 20))
        parts, size = [Files([])], 0
        for one in names:
            for path, n in listed(one, self.options.get("pathglobfilter", "*"), self.options.get("recursivefilelookup", "true") == "true"):
                if parts[-1].paths and size + n > limit:
                    parts.append(Files([]))
                    size = 0
                parts[-1].paths.append(path)
                size += n
        return parts

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kind = self.options.get("archiveformat", "").upper() or None
        mode = self.options.get("mode", "PERMISSIVE").upper()
        rows, size = [], 0
        for path in partition.paths:
            system, inner = filesystem(path)
            with system.open_input_stream(inner, compression=None) as raw:
                for r in codec.read(_Raw(raw), kind, mode):
                    if any(getattr(r, k) != v for k, v in self.equal.items()):
                        continue
                    rows.append((path, r))
                    size += len(r.content)
                    if len(rows) >= 1024 or size >= 4 << 20:
                        yield record_batch(rows)
                        rows, size = [], 0
        if rows:
            yield record_batch(rows)


_KINDS = [pa.string()] * 5 + [pa.timestamp("us", "UTC"), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]


def record_batch(rows: list[tuple[str, codec.Record]]) -> pa.RecordBatch:
    """(file, record) pairs in the columns of SCHEMA. ARC content has no HTTP header, WARC content has one."""
    columns = [[p for p, _ in rows], *([getattr(r, k) for _, r in rows] for k in ("format", "record_type", "url", "ip"))]
    columns += [[codec.instant(r.date) for _, r in rows], [r.mime for _, r in rows], [r.length for _, r in rows], [list(r.headers.items()) for _, r in rows]]
    columns.append([codec.http_body(r.content) if r.format == "ARC" else r.content for _, r in rows])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], NAMES)


class ArchiveWriter(DataSourceWriter):
    """One file a partition, each record a gzip member of its own; a failed job removes what it wrote."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.format = options["path"].rstrip("/"), options.get("archiveformat", "warc").upper()
        self.job = uuid.uuid4().hex
        if overwrite:
            system, inner = filesystem(self.path)
            system.create_dir(inner)
            system.delete_dir_contents(inner, missing_dir_ok=True)

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        name = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}-{self.job}.{self.format.lower()}.gz"
        system, inner = filesystem(f"{self.path}/{name}")
        system.create_dir(inner.rpartition("/")[0])
        n = 0
        with system.open_output_stream(inner, compression=None) as f:
            for r in rows:
                content, ts = bytes(r.content or b""), r.crawl_ts
                date = None if ts is None else ts.strftime("%Y%m%d%H%M%S" if self.format == "ARC" else "%Y-%m-%dT%H:%M:%SZ")
                f.write(gzip.compress(codec.to_bytes(codec.Record(self.format, r.record_type, r.url, r.ip, date or ("0" * 14 if self.format == "ARC" else None), r.mime_type, len(content), content))))
                n += 1
        return Written(name, n)

    def _remove(self, names) -> None:
        for name in names:
            system, inner = filesystem(f"{self.path}/{name}")
            system.delete_file(inner)

    def commit(self, messages: list) -> None:
        self._remove([m.name for m in messages if m is not None and not m.n])

    def abort(self, messages: list) -> None:
        self._remove([m.name for m in messages if m is not None])


@dataclass
class Written(WriterCommitMessage):
    name: str
    n: int


class PushingReader(ArchiveReader):
    """Also drops records of another type, format or URL before they reach Spark."""

    NAMES = {("record_type",): "record_type", ("format",): "format", ("url",): "url"}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in self.NAMES:
                self.equal[self.NAMES[f.attribute]] = f.value
            else:
                yield f


class _Raw:
    """A pyarrow stream as a buffered binary file."""

    def __new__(cls, stream):
        import io

        class Raw(io.RawIOBase):
            def readable(self) -> bool:
                return True

            def readinto(self, b) -> int:
                data = stream.read(len(b))
                b[: len(data)] = data
                return len(data)

        return io.BufferedReader(Raw(), 1 << 20)


class ArchiveSource(DataSource):
    """Options: archiveFormat (arc, warc; else by content), mode, pathGlobFilter, recursiveFileLookup, partitionBytes, paths (a JSON array)."""

    @classmethod
    def name(cls) -> str:
        return "webarchive"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict[str, str]:
        """Options under lower-case names, whichever way they came."""
        return {k.lower(): v for k, v in self.options.items()}

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self._options(), overwrite)

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else ArchiveReader)(self._options())


def read(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Raw records of crawl files. Filters on record_type, format and url are pushed down where the session allows it."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    reader = spark.read.format("webarchive").option("paths", json.dumps([path] if isinstance(path, str) else path))
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        reader = reader.option("pushdown", "true")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def write(df: DataFrame, path: str, kind: str = "warc") -> None:
    """Rows (crawl_ts, url, mime_type, content BINARY; optional record_type, ip) as ARC or WARC files, content as the format has it.

    Of WARC records, record_type is `response` by default, and the MIME type is
    what the HTTP header within the content says; an ARC record without a date
    has fourteen zeros, which is read back as none.
    """
    spark = ship(df.sparkSession)
    spark.dataSource.register(ArchiveSource)
    have = set(df.columns)
    other = lambda c, value: F.col(c) if c in have else F.lit(value).cast("string").alias(c)
    rows = df.select("crawl_ts", "url", "mime_type", "content", other("record_type", "response" if kind == "warc" else None), other("ip", None))
    rows.write.format("webarchive").mode("overwrite").option("archiveFormat", kind).save(path)


def as_records(raw: DataFrame) -> DataFrame:
    """crawl_ts, crawl_date, crawl_month, url, domain, mime_type, content, content_bytes, image_bytes, all lazy: what a query doesn't use isn't made."""
    date = F.date_format("crawl_ts", "yyyyMMdd")
    return raw.select(
        "crawl_ts",
        extract_date(date).alias("crawl_date"),
        F.date_format("crawl_ts", "yyyyMM").alias("crawl_month"),
        "url",
        host("url").alias("domain"),
        "mime_type",
        content_string("content").alias("content"),
        F.col("content").alias("content_bytes"),
        image_bytes("content").alias("image_bytes"),
    )


def load_arc(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """Every ARC record, the version block and dns: records too."""
    return as_records(read(spark, path, archiveFormat="arc", **options))


def load_warc(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """WARC responses."""
    return as_records(read(spark, path, archiveFormat="warc", **options).filter("record_type = 'response'"))


def load_archives(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """All ARC records and WARC responses of mixed files."""
    return as_records(read(spark, path, **options).filter("format = 'ARC' OR record_type = 'response'"))


def find_urls(raw: DataFrame, pattern: str) -> DataFrame:
    """file, url, mime_type, crawl_date of records (WARC: responses) whose whole URL matches."""
    rows = raw.filter("format = 'ARC' OR record_type = 'response'").filter(F.col("url").rlike(f"^(?:{pattern})$"))
    return rows.select("file", "url", "mime_type", F.date_format("crawl_ts", "yyyyMMdd").alias("crawl_date"))


def search_url(raw: DataFrame, url: str) -> DataFrame:
    """file, crawl_date, mime_type, length, url_key of the records of one URL."""
    from crawlspan.functions.url import url_to_key

    return raw.filter(F.col("url") == url).select("file", F.date_format("crawl_ts", "yyyyMMdd").alias("crawl_date"), "mime_type", "length", url_to_key("url").alias("url_key"))
