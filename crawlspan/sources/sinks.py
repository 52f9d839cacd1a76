"""Writers for graphs, entities and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspan.functions.text import tab_delimit


def save_text(df: DataFrame, path: str) -> None:
    """Rows as lines of tab-joined leaves."""
    tab_delimit(df).write.mode("overwrite").text(path)


def gdf_lines(edges: DataFrame, src: str = "src", dst: str = "dst", count: str = "count", date: str = "date") -> DataFrame:
    """part, line of a GDF file: a header and the nodes, then a header and the edges. Names aren't escaped."""
    spark = edges.sparkSession
    nodes = edges.select(F.explode(F.array(src, dst)).alias("line")).distinct().select(F.lit(1).alias("part"), "line")
    rows = edges.select(F.lit(3).alias("part"), F.concat_ws(",", src, dst, F.col(count).cast("string"), F.col(date).cast("string")).alias("line"))
    heads = spark.createDataFrame([(0, "nodedef> name VARCHAR"), (2, "edgedef> source VARCHAR,target VARCHAR,weight DOUBLE,timeint VARCHAR")], "part int, line string")
    return heads.unionByName(nodes).unionByName(rows)


def write_gdf(edges: DataFrame, path: str, **columns: str) -> None:
    """One GDF file on any file system, streamed through the driver; nothing for an empty path."""
    if not path:
        return
    ordered = gdf_lines(edges, **columns).orderBy("part", "line").select("line")
    with _file(path) as f:
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            f.write(f"{row.line}\n".encode())


def _file(path: str):
    """A binary file to write, local or under a URI that pyarrow knows."""
    from crawlspan.sources.archive import filesystem

    system, inner = filesystem(path)
    return system.open_output_stream(inner, compression=None)


def tsv_to_gdf(spark, source: str, path: str) -> None:
    """A GDF file of tab-separated (date, src, dst, count) lines."""
    write_gdf(spark.read.csv(source, sep="\t", schema="date STRING, src STRING, dst STRING, count BIGINT"), path)


def write_graph(vertices: DataFrame, edges: DataFrame, vertices_path: str, edges_path: str) -> None:
    """JSON lines: domain, pageRank, inDegree, outDegree; and date, src, dst, count with equal edges as one."""
    from crawlspan.operators.graph import edge_counts

    named = vertices.select("domain", F.col("page_rank").alias("pageRank"), F.col("in_degree").alias("inDegree"), F.col("out_degree").alias("outDegree"))
    named.write.mode("overwrite").json(vertices_path)
    edge_counts(edges).write.mode("overwrite").json(edges_path)


def write_json_array(df: DataFrame, path: str) -> int:
    """All rows as one JSON array in one file, streamed through the driver; their number."""
    n = 0
    with _file(path) as f:
        f.write(b"[")
        for row in df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator(prefetchPartitions=True):
            f.write(((",\n" if n else "\n") + row.j).encode())
            n += 1
        f.write(b"\n]\n")
    return n


def write_entities_json(triples: DataFrame, path: str, tagger=None) -> int:
    """From (date, url, content) rows to one JSON array of {date, domain, ner: [{ner_type, entities: [{entity, freq}]}]}; its length."""
    from crawlspan.functions.ner import entity_rows, extract_entities
    from crawlspan.operators.aggregate import combine_entities

    return write_json_array(combine_entities(entity_rows(extract_entities(triples, tagger))), path)


def write_found(found: DataFrame, path: str) -> None:
    """`(file url type date)` lines of `find_urls` rows."""
    words = [F.coalesce(F.col(c), F.lit("null")) for c in ("file", "url", "mime_type", "crawl_date")]
    found.select(F.concat(F.lit("("), F.concat_ws(" ", *words), F.lit(")")).alias("value")).write.mode("overwrite").text(path)


def by_month(lines: DataFrame, date: Column | str, path: str, files: int = 8) -> None:
    """Lines (`value`) into a folder for each month of their date, yyyyMM, of up to `files` files each, so that a large month isn't one task's."""
    month = F.substring(F.col(date) if isinstance(date, str) else date, 1, 6)
    lines.select("value", month.alias("month")).repartition("month", F.pmod(F.xxhash64("value"), F.lit(files))).write.mode("overwrite").partitionBy("month").text(path)


#: Lines whose entities are one file's of a kind, about, where there are more than `files` of them.
LINES = 1 << 17


def entity_lists(lines: DataFrame, path: str, dated: bool = False, files: int = 8) -> None:
    """Entities of NER lines into a folder for each kind (pers, org, loc), and for each date if `dated`, of up to `files` files each.

    From files * LINES lines on there are more files, so that a task's rows don't
    grow with the input; an entity that many lines name is spread over all of them.
    """
    from crawlspan.functions.ner import split_lists

    keys = ["date", "kind"] if dated else ["kind"]
    parts = max(files, -(-lines.count() // LINES))
    rows = split_lists(lines, F.pmod(F.xxhash64("value"), F.lit(parts)).alias("_part")).select(F.col("entity").alias("value"), *keys, "_part")
    by = [*keys, F.col("_part")]
    rows = rows.repartition(*by) if parts == files else rows.repartition(4 * parts, *by)
    rows.drop("_part").write.mode("overwrite").partitionBy(*keys).text(path)
