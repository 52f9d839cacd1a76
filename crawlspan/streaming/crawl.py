"""Streaming forms: files as they come, late captures, counts by day. The batch library has no such operators; these go beyond it."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.session import ship
from crawlspan.sources import codec
from crawlspan.sources.archive import SCHEMA, record_batch


def stream_archives(spark: SparkSession, path: str, pattern: str = "*arc*") -> DataFrame:
    """Raw crawl records of files as they come into a folder; each file is read whole in one task."""
    ship(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                records = codec.read(io.BufferedReader(io.BytesIO(data.as_py())))
                while rows := [(name, r) for _, r in zip(range(256), records)]:
                    yield record_batch(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def first_captures(records: DataFrame, late: str = "1 day") -> DataFrame:
    """Records whose (url, digest) didn't come before, within the watermark."""
    return records.withColumn("digest", F.md5("content")).withWatermark("crawl_ts", late).dropDuplicatesWithinWatermark(["url", "digest"])


def pages_by_day(records: DataFrame, late: str = "1 day", ts: str = "crawl_ts") -> DataFrame:
    """day, n of records over tumbling days."""
    days = records.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.col("window.start").alias("day"), "n")


def ingest(records: DataFrame, store, name: str, checkpoint: str):
    """Feeds a stream of raw records to a collection, a micro-batch at a time; replaying one changes nothing."""
    return records.writeStream.foreachBatch(lambda df, _: store.ingest(df, name, counted=False)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
