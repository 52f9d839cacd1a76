"""Line-based sources: tweets, entity scrapes, site prefixes, URL lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.functions.tweet import parsed


def parse_tweets(lines: DataFrame) -> DataFrame:
    """`tweet` (VARIANT) of each line (`value`) that is JSON and no delete notice."""
    rows = lines.filter(~F.col("value").startswith('{"delete":'))
    return rows.select(parsed("value").alias("tweet")).filter(F.col("tweet").isNotNull())


def load_tweets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_tweets(spark.read.text(path))


_SCRAPE = r"^\(([^,]*),([^,]*),(.*)\)$"


def load_scrape(spark: SparkSession, path: str) -> DataFrame:
    """date, url, content of `(date,url,content)` lines; commas stay within the content."""
    return parse_scrape(spark.read.text(path))


def parse_scrape(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").rlike(_SCRAPE)).select(*[F.regexp_extract("value", _SCRAPE, k + 1).alias(c) for k, c in enumerate(("date", "url", "content"))])


def parse_triples(lines: DataFrame) -> DataFrame:
    """date, url, content of `date,url,content` lines, parentheses kept; missing parts are NULL."""
    parts = F.split("value", ",", 3)
    return lines.select(*[F.get(parts, k).alias(c) for k, c in enumerate(("date", "url", "content"))])


def load_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """prefix_id, prefix of a CSV with a header; rows without both are dropped."""
    rows = spark.read.csv(path, header=True, schema="prefix_id INT, prefix STRING", mode="DROPMALFORMED", enforceSchema=True)
    return rows.filter("prefix_id IS NOT NULL AND prefix IS NOT NULL")


def load_url_list(spark: SparkSession, path: str) -> DataFrame:
    """url: first word of each line that isn't blank."""
    first = F.get(F.split(F.trim("value"), r"\s+"), 0)
    return spark.read.text(path).select(first.alias("url")).filter("url != ''")
