"""Images that stand under many URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlspan.functions.media import image_size
from crawlspan.functions.text import md5_hex
from crawlspan.operators.aggregate import first_per_key
from crawlspan.operators.filters import keep_images, large_enough


def popular_images(records: DataFrame, limit: int, min_width: int = 30, min_height: int = 30, content: str = "image_bytes") -> DataFrame:
    """url, count of the `limit` commonest images by content, with the least URL of each; ties by URL.

    Sizes are read where the image lies, so that no image is shuffled.
    """
    one = keep_images(records).select(md5_hex(content).alias("md5"), "url", F.lit(1).cast("long").alias("count"), F.inline(F.array(image_size(content))))
    counted = first_per_key(large_enough(one, min_width, min_height), "md5", "count", "url")
    return counted.orderBy(F.desc("count"), "url").limit(limit).select("url", "count")
