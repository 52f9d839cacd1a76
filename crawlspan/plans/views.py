"""The records view over the `pages` table, in Spark and in SQL.

The driver's tables hold no crawl files, so MIME type and crawl date are
derived from page_id, with NULLs among both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.session import ship

RECORDS_SQL = """records AS (
  SELECT page_id, url, html AS content,
    CASE page_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/xhtml+xml'
      WHEN 3 THEN 'text/plain' ELSE 'text/html' END AS mime_type,
    CASE WHEN page_id % 11 = 0 THEN NULL
      ELSE strftime(DATE '2008-04-01' + CAST(page_id % 60 AS INTEGER), '%Y%m%d') END AS crawl_date
  FROM pages)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages: page_id, url, content, mime_type, crawl_date (yyyyMMdd)."""
    pages = ship(spark).read.parquet(f"{sf_dir}/pages.parquet")
    m = F.col("page_id") % 7
    return pages.select(
        "page_id",
        "url",
        F.col("html").alias("content"),
        F.when(m == 0, F.lit(None)).when(m == 1, "image/png").when(m == 2, "application/xhtml+xml").when(m == 3, "text/plain").otherwise("text/html").alias("mime_type"),
        F.when(F.col("page_id") % 11 != 0, F.date_format(F.date_add(F.lit("2008-04-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyyMMdd")).alias("crawl_date"),
    )
