"""A time-versioned store of captures, its catalog, and look-ups for replay.

captures: url_key, mime_type, ts, url, content; one row a version, the key
(url_key, mime_type, ts). A collection is a folder of parquet files to which
each ingest appends one batch, sorted by url_key, so that a look-up reads few
row groups and an ingest costs what it brings. Of rows of one key the latest
batch counts, which readers work out. `compact` writes what counts into a new
folder; the catalog's last line for a name says which folder it has, hence a
collection changes folders in one step and is never half-written.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from crawlspan.functions.text import parse_instant
from crawlspan.functions.url import url_to_key
from crawlspan.operators.filters import MAX_BYTES, ingestible

KEY = ("url_key", "mime_type", "ts")
SCHEMA = "url_key string, mime_type string, ts timestamp, url string, content binary"


def upsert(old: DataFrame | None, new: DataFrame, order: str | None = None) -> DataFrame:
    """The union of two sets of captures; of one key the row of `new`, and of those the greatest by `order`, else by the content's hash."""
    rows = new.withColumn("_r", F.lit(1))
    if old is not None:
        rows = old.withColumn("_r", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    last = Window.partitionBy(*KEY).orderBy(F.desc("_r"), F.desc(order) if order else F.md5("content").desc())
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k", "_r")


def to_captures(raw: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Captures of raw crawl records (see sources.archive) that ingest takes."""
    keyed = raw.withColumn("url_key", url_to_key("url")).filter(F.col("crawl_ts").isNotNull())
    return ingestible(keyed, max_bytes).select("url_key", "mime_type", F.col("crawl_ts").alias("ts"), "url", "content")


_CATALOG = "name string, created timestamp, dropped boolean, folder string, noted timestamp"


class Store:
    """Collections of captures under one folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *names: str) -> str:
        return posixpath.join(self.path, *names)

    def dump(self) -> DataFrame:
        """name, created, dropped, folder, noted: every line of the catalog, also of what was dropped or compacted."""
        try:
            return self.spark.read.schema(_CATALOG).json(self._at("_catalog"))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], _CATALOG)
            raise

    def _last(self) -> DataFrame:
        last = self.dump().groupBy("name").agg(F.max_by(F.struct("created", "dropped", "folder"), "noted").alias("x"))
        return last.filter("NOT x.dropped").select("name", "x.created", "x.folder")

    def collections(self) -> DataFrame:
        """name, created of the collections that exist."""
        return self._last().select("name", "created")

    def _note(self, name: str, created: datetime, dropped: bool, folder: str) -> None:
        row = self.spark.createDataFrame([(name, created, dropped, folder, datetime.now())], _CATALOG)
        row.write.mode("append").json(self._at("_catalog"))

    def create(self, name: str, force: bool = False) -> None:
        """A new, empty collection; one of that name is an error unless `force` puts the new one in its place."""
        if self.collections().filter(F.col("name") == name).take(1) and not force:
            raise ValueError(f"collection {name} exists")
        folder = self._folder(name)
        self._append(self.spark.createDataFrame([], SCHEMA), folder, 0, "snappy")
        self._note(name, datetime.now(), False, folder)

    def drop(self, name: str) -> None:
        """The collection is no longer listed; its files stay until someone deletes the folder that `dump` names."""
        row = self._need(name)
        self._note(name, row.created, True, row.folder)

    def _need(self, name: str):
        rows = self._last().filter(F.col("name") == name).take(1)
        if not rows:
            raise ValueError(f"no collection {name}")
        return rows[0]

    def _folder(self, name: str) -> str:
        return posixpath.join("captures", f"{name}-{uuid.uuid4().hex[:12]}")

    def _append(self, df: DataFrame, folder: str, batch: int, compression: str) -> None:
        rows = df.withColumn("batch", F.lit(batch).cast("long")).sortWithinPartitions(*KEY)
        rows.write.mode("append").option("compression", compression).parquet(self._at(folder))

    def captures(self, name: str) -> DataFrame:
        """The captures of a collection; filters on url_key, mime_type and ts reach the files."""
        rows = self.spark.read.schema(SCHEMA + ", batch bigint").parquet(self._at(self._need(name).folder))
        last = F.max_by(F.struct("url", "content"), F.struct("batch", F.md5("content"))).alias("x")
        return rows.groupBy(*KEY).agg(last).select(*KEY, "x.url", "x.content")

    def ingest(self, raw: DataFrame, name: str, max_bytes: int = MAX_BYTES, compression: str = "snappy", counted: bool = True) -> dict[str, int]:
        """Appends raw crawl records as one batch; a capture that exists is replaced. Returns counts of records: seen, too_large, invalid, taken; none unless `counted`.

        compression: any codec of parquet, such as snappy, gzip or zstd. The same
        records once more change nothing but the size on disk.
        """
        folder, batch = self._need(name).folder, time.time_ns()
        if not counted:
            self._append(to_captures(raw, max_bytes), folder, batch, compression)
            return {}
        seen, taken = Observation(), Observation()
        keyed = raw.withColumn("_key", url_to_key("url"))
        count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        watched = keyed.observe(seen, F.count(F.lit(1)).alias("seen"), count(F.octet_length("content") > max_bytes).alias("too_large"), count(F.col("_key").isNull()).alias("invalid"))
        fresh = to_captures(watched.drop("_key"), max_bytes).observe(taken, F.count(F.lit(1)).alias("taken"))
        self._append(fresh, folder, batch, compression)
        return seen.get | taken.get

    def ingest_files(self, path: str, name: str, start: int = 0, step: int = 64, max_bytes: int = MAX_BYTES, compression: str = "snappy") -> dict[str, int]:
        """Ingests crawl files in the order of their names from number `start` on, `step` files a batch; the sums of `ingest`'s counts and `next`.

        After a failure the message names the number of the file to start from
        again; files of the batch that failed may come twice, which changes nothing.
        """
        from crawlspan.sources.archive import listed, read

        files = [p for p, _ in listed(path)]
        total: dict[str, int] = {"seen": 0, "too_large": 0, "invalid": 0, "taken": 0}
        for i in range(start, len(files), step):
            try:
                got = self.ingest(read(self.spark, files[i : i + step]), name, max_bytes, compression)
            except Exception as e:
                raise RuntimeError(f"ingest failed; start again from file {i}") from e
            total = {k: total[k] + got[k] for k in total}
        return total | {"next": max(start, len(files))}

    def compact(self, name: str, compression: str = "snappy") -> None:
        """Writes what counts into a new folder, sorted by key over all files, and points the catalog to it."""
        row, folder = self._need(name), self._folder(name)
        self._append(self.captures(name).repartitionByRange(*KEY), folder, time.time_ns(), compression)
        self._note(name, row.created, False, folder)

    def content(self, name: str, url: str, instant: str) -> bytes | None:
        """Content of the one capture of a URL at a 14-digit instant; None if there is none or several."""
        rows = at_instant(self.captures(name), url, instant).take(2)
        return bytes(rows[0].content) if len(rows) == 1 else None


def of_url(captures: DataFrame, url: str) -> DataFrame:
    """Captures of a URL."""
    return captures.filter(F.col("url_key") == url_to_key(F.lit(url)))


def at_instant(captures: DataFrame, url: str, instant: str) -> DataFrame:
    return of_url(captures, url).filter(F.col("ts") == parse_instant(F.lit(instant)))


def history(captures: DataFrame, url: str) -> DataFrame:
    """ts, mime_type of each capture of a URL, oldest first."""
    return of_url(captures, url).select("ts", "mime_type").orderBy("ts", "mime_type")


def closest(captures: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each (url_key, at) of `wanted` the capture nearest in time, ties to the earlier: url_key, at, ts, mime_type.

    One equi-join on url_key and one aggregation with map-side combine.
    """
    gap = F.abs(F.unix_micros("ts") - F.unix_micros("at"))
    best = F.min(F.struct(gap.alias("gap"), "ts", "mime_type")).alias("b")
    return wanted.join(captures.select("url_key", "ts", "mime_type"), "url_key").groupBy("url_key", "at").agg(best).select("url_key", "at", "b.ts", "b.mime_type")


def capture_query(captures: DataFrame, url: str, begin: str | None = None, end: str | None = None, at: str | None = None, page: int = 1, size: int = 100) -> DataFrame:
    """One page of the captures of a URL by time, with `n` from 1 and `is_closest` to the instant `at` (the last if None)."""
    rows = of_url(captures, url).select("url_key", "url", "ts", "mime_type")
    for bound, ahead in ((begin, True), (end, False)):
        if bound is not None:
            t = parse_instant(F.rpad(F.lit(bound), 14, "0") if ahead else F.lit(bound.ljust(14, "9") if len(bound) == 14 else bound + "235959"))
            rows = rows.filter(F.col("ts") >= t if ahead else F.col("ts") <= t)
    order = Window.orderBy("ts", "mime_type")  # the captures of one URL
    gap = F.abs(F.unix_micros("ts") - F.unix_micros(parse_instant(F.lit(at)))) if at else -F.unix_micros("ts")
    numbered = rows.withColumn("n", F.row_number().over(order)).withColumn("is_closest", F.row_number().over(Window.orderBy(gap, "ts", "mime_type")) == 1)
    return numbered.filter((F.col("n") > (page - 1) * size) & (F.col("n") <= page * size)).orderBy("n")
