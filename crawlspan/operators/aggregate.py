"""Counting, ranking and reshaping of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_items(df: DataFrame, *columns: str, name: str = "count") -> DataFrame:
    """Rows per distinct combination of `columns` (all by default), most frequent first, ties by value."""
    keys = list(columns or df.columns)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys)


def links(records: DataFrame, base: str | None = "url", also: tuple[str, ...] = ()) -> DataFrame:
    """One row a link: crawl_date, further columns of the record, src, dst, anchor. base: the column that relative links resolve against; None drops them."""
    from crawlspan.functions.html import extract_links

    found = extract_links("url", "content", base)
    return records.select("crawl_date", *also, F.inline(found))


def first_per_key(df: DataFrame, key: str, count: str, *first: str) -> DataFrame:
    """Counts summed by `key`, with the least row of the `first` columns."""
    least = F.min(F.struct(*first)).alias("_f")
    return df.groupBy(key).agg(F.sum(count).alias(count), least).select(key, count, *[F.col(f"_f.{c}").alias(c) for c in first])


def pivot_top(df: DataFrame, row: str, column: str, count: str, top: int = 20, other: str = "other") -> DataFrame:
    """`count` summed by `row` x the `top` values of `column` by total, the rest as `other`, missing cells 0.

    The list of columns, `top` names long, is the one thing collected.
    """
    ranked = df.groupBy(column).agg(F.sum(count).alias("_n")).orderBy(F.desc("_n"), column).limit(top)
    names = [r[0] for r in ranked.collect()]
    bucket = F.when(F.col(column).isin(*names), F.col(column).cast("string")).otherwise(F.lit(other))
    return df.select(row, bucket.alias("_b"), count).groupBy(row).pivot("_b", [*map(str, names), other]).agg(F.sum(count)).na.fill(0)


def entity_rollup(df: DataFrame) -> DataFrame:
    """Frequencies of (ner_type, entity) over all time and by year, month and day: period '', yyyy, yyyyMM, yyyyMMdd."""
    sizes = F.explode(F.array(F.lit(0), F.lit(4), F.lit(6), F.lit(8)))
    parts = df.select("ner_type", "entity", "freq", "date", sizes.alias("size"))
    return parts.groupBy("ner_type", F.expr("substring(date, 1, size)").alias("period"), "size", "entity").agg(F.sum("freq").alias("freq")).drop("size")


def explode_entities(df: DataFrame) -> DataFrame:
    """date, domain, ner_type, entity, freq of rows (date, domain, ner: array of {ner_type, entities: array of {entity, freq}})."""
    one = df.select("date", "domain", F.explode("ner").alias("n"))
    return one.select("date", "domain", F.col("n.ner_type").alias("ner_type"), F.inline("n.entities"))


def combine_entities(df: DataFrame) -> DataFrame:
    """The inverse of `explode_entities`: counts of (date, domain, ner_type, entity) rows, nested by date and domain."""
    counts = df.groupBy("date", "domain", "ner_type", "entity").agg(F.count(F.lit(1)).alias("freq"))
    entities = F.array_sort(F.collect_list(F.struct("entity", "freq"))).alias("entities")
    typed = counts.groupBy("date", "domain", "ner_type").agg(entities)
    return typed.groupBy("date", "domain").agg(F.array_sort(F.collect_list(F.struct("ner_type", "entities"))).alias("ner"))


def top_subgraph(edges: DataFrame, n: int = 100, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose ends are both among the `n` nodes of most edges, ties by name."""
    ends = edges.select(F.explode(F.array(src, dst)).alias("node"))
    top = ends.groupBy("node").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "node").limit(n).select("node")
    keep = edges.join(F.broadcast(top.withColumnRenamed("node", src)), src, "left_semi")  # n rows
    return keep.join(F.broadcast(top.withColumnRenamed("node", dst)), dst, "left_semi")


def year_span(df: DataFrame, date: str) -> DataFrame:
    """first_year, last_year of a DATE column: the ends of a time slider."""
    return df.agg(F.year(F.min(date)).cast("long").alias("first_year"), F.year(F.max(date)).cast("long").alias("last_year"))


def top_entities(df: DataFrame, n: int = 50) -> DataFrame:
    """entity, freq of the `n` commonest entities of (entity) rows, ties by name, listed by name."""
    counted = df.groupBy("entity").agg(F.count(F.lit(1)).alias("freq"))
    return counted.orderBy(F.desc("freq"), "entity").limit(n).orderBy("entity")
