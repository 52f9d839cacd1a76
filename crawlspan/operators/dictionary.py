"""URL dictionaries: dense ids in URL order, prefix lookup, prefix intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.session import cut_lineage


def url_ids(urls: DataFrame, url: str = "url") -> DataFrame:
    """url, id of each distinct URL, ids from 0 in byte order of the URLs.

    Range partitions are sorted and numbered each on its own; their sizes, one
    number a partition, are summed up on the driver. The sorted URLs are written
    first, so that numbering and counting see the same partitions.
    """
    placed = urls.select(F.col(url).alias("url")).dropna().distinct().repartitionByRange("url").sortWithinPartitions("url")
    numbered = cut_lineage(placed.select("url", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m")))
    sizes = {r.p: r.n for r in numbered.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    base, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        base.append((p, total))
        total += sizes.get(p, 0)
    bases = numbered.sparkSession.createDataFrame(base, "p int, base long")
    return numbered.join(F.broadcast(bases), "p").select("url", (F.col("base") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


def lookup(df: DataFrame, ids: DataFrame, url: str = "url", name: str = "id") -> DataFrame:
    """`df` with the id of its URL, -1 where unknown."""
    named = ids.select(F.col("url").alias("_u"), F.col("id").alias(name))
    return df.join(named, F.col(url) == F.col("_u"), "left").drop("_u").withColumn(name, F.coalesce(name, F.lit(-1)))


def reverse_lookup(df: DataFrame, ids: DataFrame, id: str = "id", name: str = "url") -> DataFrame:
    """`df` with the URL of its id, NULL where unknown."""
    named = ids.select(F.col("id").alias("_i"), F.col("url").alias(name))
    return df.join(named, F.col(id) == F.col("_i"), "left").drop("_i")


def prefix_search(ids: DataFrame, prefix: str | None) -> DataFrame:
    """url, id of the URLs that begin with `prefix`, in order; none for '' or None."""
    return ids.filter(F.col("url").startswith(prefix)).orderBy("url") if prefix else ids.limit(0)


def id_range(ids: DataFrame, first: str, last: str) -> tuple[int, int] | None:
    """Ids of two URLs; None if either is unknown."""
    r = ids.filter(F.col("url").isin(first, last)).agg(F.min(F.when(F.col("url") == first, F.col("id"))).alias("a"), F.max(F.when(F.col("url") == last, F.col("id"))).alias("b")).first()
    return None if r.a is None or r.b is None else (r.a, r.b)


def prefix_candidates(df: DataFrame, prefixes: DataFrame, url: str) -> DataFrame:
    """`df` x the prefixes of its URL that `prefixes` (prefix_id, prefix) holds: an equi-join on substrings of the lengths that occur."""
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
    cuts = F.array(*[F.lit(n) for n in lengths if n]).cast("array<int>")
    each = df.select("*", F.explode(F.filter(cuts, lambda n: n <= F.length(url))).alias("_n"))
    return each.withColumn("prefix", F.substring(F.col(url), F.lit(1), F.col("_n"))).drop("_n").join(prefixes, "prefix")


def prefix_intervals(ids: DataFrame, prefixes: DataFrame) -> DataFrame:
    """prefix_id, prefix, start_id, end_id of each prefix that a URL begins with."""
    hits = prefix_candidates(ids, prefixes, "url")
    return hits.groupBy("prefix_id", "prefix").agg(F.min("id").alias("start_id"), F.max("id").alias("end_id"))


def site_of(df: DataFrame, prefixes: DataFrame, url: str, name: str) -> DataFrame:
    """`df` with the id of the longest prefix of its URL as `name`; rows without one are dropped."""
    keys = df.select(F.col(url).alias("_u")).distinct()
    best = prefix_candidates(keys, prefixes, "_u").groupBy("_u").agg(F.max(F.struct(F.length("prefix"), -F.col("prefix_id"))).alias("_b"))
    return df.join(best.select("_u", (-F.col("_b.col2")).alias(name)), F.col(url) == F.col("_u")).drop("_u")


def save(ids: DataFrame, path: str) -> None:
    """A dictionary (url, id) as parquet, in URL order within each file, so that look-ups and prefix searches skip row groups."""
    ids.select("url", "id").sortWithinPartitions("url").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """url, id of a dictionary that `save` wrote."""
    return spark.read.schema("url string, id bigint").parquet(path)
