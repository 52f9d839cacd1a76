"""Queries over crawl files, text files and the capture store: each writes what it then reads, to the shared folder.

The driver's tables hold no crawl files, so the records view is written as ARC
and WARC files and the readers' results are compared with SQL on the view.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crawlspan.functions import html as H
from crawlspan.functions import lang
from crawlspan.functions.url import url_to_key
from crawlspan.operators import dictionary as D
from crawlspan.operators import filters as K
from crawlspan.operators import graph as G
from crawlspan.operators import index as I
from crawlspan.operators.store import Store
from crawlspan.plans.links import TEXT_SQL, trade
from crawlspan.plans.registry import query, table
from crawlspan.plans.store import _KEY
from crawlspan.plans.views import RECORDS_SQL, records
from crawlspan.session import shared_dir
from crawlspan.sources import archive, sinks
from crawlspan.sources import text as T


def _place(spark) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


def _arc(spark, sf_dir) -> str:
    """The records view as ARC files."""
    r = records(spark, sf_dir)
    at = f"{_place(spark)}/arc"
    archive.write(r.select(F.to_timestamp("crawl_date", "yyyyMMdd").alias("crawl_ts"), "url", "mime_type", F.encode("content", "UTF-8").alias("content")), at, "arc")
    return at


def _warc(spark, sf_dir) -> str:
    """The records view as WARC files; every fifth page is a request."""
    r = records(spark, sf_dir)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), F.coalesce(F.concat(F.lit("Content-Type: "), "mime_type", F.lit("\r\n")), F.lit("")), F.lit("\r\n"))
    kind = F.when(F.col("page_id") % 5 == 0, "request").otherwise("response").alias("record_type")
    at = f"{_place(spark)}/warc"
    archive.write(r.select(F.to_timestamp("crawl_date", "yyyyMMdd").alias("crawl_ts"), "url", "mime_type", F.encode(F.concat(head, "content"), "UTF-8").alias("content"), kind), at)
    return at


_ROW = "url, crawl_date, crawl_month, domain, mime_type, digest, size"
_SQL_ROW = "url, crawl_date, substring(crawl_date, 1, 6) AS crawl_month, regexp_extract(url, '^https?://([^/:?#]*)', 1) AS domain"
_HEAD = "'HTTP/1.1 200 OK' || chr(13) || chr(10) || coalesce('Content-Type: ' || mime_type || chr(13) || chr(10), '') || chr(13) || chr(10)"


def _loaded(df):
    return df.select("url", "crawl_date", "crawl_month", "domain", "mime_type", F.md5("content_bytes").alias("digest"), F.length("content").cast("long").alias("size"))


_ARC_SQL = f"SELECT {_SQL_ROW}, coalesce(mime_type, 'no-type') AS mime_type, md5(content) AS digest, length(content) AS size FROM records"
_WARC_SQL = f"SELECT {_SQL_ROW}, mime_type, md5({_HEAD} || content) AS digest, length({_HEAD} || content) AS size FROM records WHERE page_id % 5 <> 0"


@query("load_arc", f"WITH {RECORDS_SQL} {_ARC_SQL}")
def load_arc(spark, sf_dir):
    return _loaded(archive.load_arc(spark, _arc(spark, sf_dir)))


@query("load_warc", f"WITH {RECORDS_SQL} {_WARC_SQL}")
def load_warc(spark, sf_dir):
    return _loaded(archive.load_warc(spark, _warc(spark, sf_dir)))


@query("load_archives", f"WITH {RECORDS_SQL} {_ARC_SQL} UNION ALL {_WARC_SQL}")
def load_archives(spark, sf_dir):
    return _loaded(archive.load_archives(spark, [_arc(spark, sf_dir), _warc(spark, sf_dir)]))


@query(
    "archive_records",
    f"""WITH {RECORDS_SQL} SELECT 'ARC' AS format, NULL AS record_type, count(*) AS n, sum(octet_length(encode(content)))::BIGINT AS bytes FROM records
UNION ALL SELECT 'WARC', CASE WHEN page_id % 5 = 0 THEN 'request' ELSE 'response' END, count(*), sum(octet_length(encode({_HEAD} || content)))::BIGINT FROM records GROUP BY 2""",
)
def archive_records(spark, sf_dir):
    raw = archive.read(spark, [_arc(spark, sf_dir), _warc(spark, sf_dir)])
    return raw.groupBy("format", "record_type").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


_BLOG = "https://blog[.].*html"


@query("found_urls", f"WITH {RECORDS_SQL} SELECT url, mime_type, crawl_date FROM records WHERE page_id % 5 <> 0 AND regexp_full_match(url, '{_BLOG}')")
def found_urls(spark, sf_dir):
    return archive.find_urls(archive.read(spark, _warc(spark, sf_dir)), _BLOG).drop("file")


@query("found_url_lines", f"WITH {RECORDS_SQL} SELECT '(' || url || ' ' || coalesce(mime_type, 'null') || ' ' || coalesce(crawl_date, 'null') || ')' AS line FROM records WHERE page_id % 5 <> 0 AND regexp_full_match(url, '{_BLOG}')")
def found_url_lines(spark, sf_dir):
    at = _place(spark)
    sinks.write_found(archive.find_urls(archive.read(spark, _warc(spark, sf_dir)), _BLOG), at)
    return spark.read.text(at).select(F.regexp_replace("value", r"^\(\S+ ", "(").alias("line"))


@query("url_search", f"WITH {RECORDS_SQL} SELECT crawl_date, coalesce(mime_type, 'no-type') AS mime_type, octet_length(encode(content)) AS length, {_KEY} AS url_key FROM records WHERE url = (SELECT min(url) FROM pages)")
def url_search(spark, sf_dir):
    asked = table(spark, sf_dir, "pages").agg(F.min("url")).first()[0]
    return archive.search_url(archive.read(spark, _arc(spark, sf_dir)), asked).drop("file")


_LINE = "regexp_replace(text, '[\\r\\n]+', ' ', 'g')"


def _lines(spark, sf_dir):
    """date, url, content of documents, one line each."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select(F.lit("20080430").alias("date"), F.concat(F.lit("http://h/"), F.col("doc_id").cast("string")).alias("url"), F.regexp_replace("text", "[\r\n]+", " ").alias("content"))


_LINES_SQL = f"SELECT '20080430' AS date, 'http://h/' || doc_id AS url, {_LINE} AS content FROM documents WHERE text IS NOT NULL"


@query("scrape_lines", _LINES_SQL)
def scrape_lines(spark, sf_dir):
    at = _place(spark)
    _lines(spark, sf_dir).select(F.concat(F.lit("("), F.concat_ws(",", "date", "url", "content"), F.lit(")")).alias("value")).write.text(at)
    return T.load_scrape(spark, at)


@query("triple_lines", _LINES_SQL)
def triple_lines(spark, sf_dir):
    return T.parse_triples(_lines(spark, sf_dir).select(F.concat_ws(",", "date", "url", "content").alias("value")))


@query("prefix_file", "SELECT CAST(n_nationkey AS INTEGER) AS prefix_id, 'http://' || n_name || '/' AS prefix FROM nation WHERE n_nationkey % 4 <> 1")
def prefix_file(spark, sf_dir):
    n, at = table(spark, sf_dir, "nation"), _place(spark)
    key = F.when(F.col("n_nationkey") % 4 != 1, F.col("n_nationkey").cast("string")).otherwise("none")
    n.select(key.alias("id"), F.concat(F.lit("http://"), "n_name", F.lit("/")).alias("url")).write.csv(at, header=True)
    return T.load_prefixes(spark, at)


@query("url_list", "SELECT url FROM pages")
def url_list(spark, sf_dir):
    at = _place(spark)
    table(spark, sf_dir, "pages").select(F.explode(F.array(F.concat(F.lit("  "), "url", F.lit(" 12 x")), F.lit(""), F.lit("   "))).alias("value")).write.text(at)
    return T.load_url_list(spark, at)


@query("text_file", "SELECT coalesce(CAST(n_nationkey AS VARCHAR), 'null') || chr(9) || n_name || chr(9) || n_regionkey AS line FROM nation")
def text_file(spark, sf_dir):
    at = _place(spark)
    sinks.save_text(table(spark, sf_dir, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("s")), at)
    return spark.read.text(at).select(F.col("value").alias("line"))


_COUNTED = "e AS (SELECT strftime(o_orderdate, '%Y') AS date, 'n' || (o_custkey % 9) AS src, 'n' || (o_orderkey % 7) AS dst, count(*) AS n FROM orders GROUP BY ALL)"
_GDF_SQL = f"""WITH {_COUNTED} SELECT 'nodedef> name VARCHAR' AS line UNION ALL SELECT DISTINCT x FROM (SELECT src AS x FROM e UNION SELECT dst FROM e)
UNION ALL SELECT 'edgedef> source VARCHAR,target VARCHAR,weight DOUBLE,timeint VARCHAR' UNION ALL SELECT src || ',' || dst || ',' || n || ',' || date FROM e"""


def _counted(spark, sf_dir):
    name = lambda c, k: F.concat(F.lit("n"), (F.col(c) % k).cast("string"))
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.date_format("o_orderdate", "yyyy").alias("date"), name("o_custkey", 9).alias("src"), name("o_orderkey", 7).alias("dst")).agg(F.count(F.lit(1)).alias("count"))


@query("gdf_file", _GDF_SQL)
def gdf_file(spark, sf_dir):
    at = _place(spark)
    sinks.write_gdf(_counted(spark, sf_dir), f"{at}.gdf")
    return spark.read.text(f"{at}.gdf").select(F.col("value").alias("line"))


@query("gdf_from_tsv", _GDF_SQL)
def gdf_from_tsv(spark, sf_dir):
    at = _place(spark)
    _counted(spark, sf_dir).select("date", "src", "dst", "count").write.csv(at, sep="\t")
    sinks.tsv_to_gdf(spark, at, f"{at}.gdf")
    return spark.read.text(f"{at}.gdf").select(F.col("value").alias("line"))


@query("json_array", "SELECT n_nationkey, n_name FROM nation")
def json_array(spark, sf_dir):
    at = _place(spark)
    sinks.write_json_array(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{at}.json")
    return spark.read.json(f"{at}.json", schema="n_nationkey bigint, n_name string", multiLine=True)


@query(
    "graph_files",
    """WITH e AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT 'n' || node AS name, count_if(i) AS "in", count_if(NOT i) AS "out" FROM (SELECT dst AS node, TRUE AS i FROM e UNION ALL SELECT src, FALSE FROM e) GROUP BY node
UNION ALL SELECT 'n' || src || '-n' || dst, count(*), 0 FROM e GROUP BY src, dst""",
)
def graph_files(spark, sf_dir):
    """Both JSON files of a graph, read back: its nodes with degrees, its edges with counts."""
    at, named = _place(spark), lambda c: F.concat(F.lit("n"), F.col(c).cast("string")).alias(c)
    e = trade(spark, sf_dir).select(F.lit("20080430").alias("crawl_date"), named("src"), named("dst"))
    v = G.degrees(e).select(F.col("node").alias("domain"), F.lit(1.0).alias("page_rank"), "in_degree", "out_degree")
    sinks.write_graph(v, e, f"{at}/v", f"{at}/e")
    nodes = spark.read.json(f"{at}/v").select(F.col("domain").alias("name"), F.col("inDegree").alias("in"), F.col("outDegree").alias("out"))
    edges = spark.read.json(f"{at}/e").select(F.concat_ws("-", "src", "dst").alias("name"), F.col("count").alias("in"), F.lit(0).cast("long").alias("out"))
    return nodes.unionByName(edges)


@query("month_files", "SELECT strftime(o_orderdate, '%Y%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def month_files(spark, sf_dir):
    at = _place(spark)
    lines = table(spark, sf_dir, "orders").select(F.concat_ws(" ", F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey").cast("string")).alias("value"))
    sinks.by_month(lines, F.col("value"), at)
    back = spark.read.schema("value string, month string").text(at).filter(F.col("value").startswith(F.col("month")))
    return back.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


def _ner_lines(spark, sf_dir):
    """Lines of entity lists, one for each order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    return o.select(F.concat(F.date_format("o_orderdate", "yyyy'0101'"), F.lit(" {PERSON=[p"), k, F.lit(", q], ORGANIZATION=["), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("o"), k)).otherwise(""), F.lit("], LOCATION=[]}")).alias("value"))


_NER_SQL = """x AS (SELECT strftime(o_orderdate, '%Y0101') AS date, 'pers' AS kind, 'p' || o_orderkey AS entity FROM orders UNION ALL SELECT strftime(o_orderdate, '%Y0101'), 'pers', 'q' FROM orders
  UNION ALL SELECT strftime(o_orderdate, '%Y0101'), 'org', 'o' || o_orderkey FROM orders WHERE o_orderkey % 2 = 0)"""


@query("entity_files", f"WITH {_NER_SQL} SELECT kind, entity, count(*) AS n FROM x GROUP BY ALL")
def entity_files(spark, sf_dir):
    at = _place(spark)
    sinks.entity_lists(_ner_lines(spark, sf_dir), at)
    return spark.read.schema("value string, kind string").text(at).groupBy("kind", F.col("value").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


@query("dated_entity_files", f"WITH {_NER_SQL} SELECT date, kind, entity, count(*) AS n FROM x GROUP BY ALL")
def dated_entity_files(spark, sf_dir):
    at = _place(spark)
    sinks.entity_lists(_ner_lines(spark, sf_dir), at, dated=True)
    return spark.read.schema("value string, date string, kind string").text(at).groupBy("date", "kind", F.col("value").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


_STORED = f"coalesce(mime_type, 'no-type') AS mime_type, {_KEY} AS url_key, strptime(crawl_date, '%Y%m%d') AS ts"


def _stored(spark, sf_dir, max_bytes: int = 4000):
    store, files = Store(spark, _place(spark)), _arc(spark, sf_dir)
    store.create("c")
    return store, store.ingest_files(files, "c", step=3, max_bytes=max_bytes), files


@query(
    "store_ingest",
    f"""WITH {RECORDS_SQL} SELECT count(*) AS seen, count_if(octet_length(encode(content)) > 4000) AS too_large, 0::BIGINT AS invalid, count_if(crawl_date IS NOT NULL AND octet_length(encode(content)) <= 4000) AS taken FROM records""",
)
def store_ingest(spark, sf_dir):
    got = _stored(spark, sf_dir)[1]
    names = ("seen", "too_large", "invalid", "taken")
    return spark.createDataFrame([tuple(got[k] for k in names)], ", ".join(f"{k} long" for k in names))


@query("store_captures", f"WITH {RECORDS_SQL} SELECT url_key, mime_type, ts, max(digest) AS digest FROM (SELECT {_STORED}, md5(content) AS digest FROM records WHERE crawl_date IS NOT NULL AND octet_length(encode(content)) <= 4000) GROUP BY ALL")
def store_captures(spark, sf_dir):
    """The captures of a collection whose files came twice and which was compacted in between."""
    store, _, files = _stored(spark, sf_dir)
    store.compact("c")
    store.ingest_files(files, "c", start=1, max_bytes=4000)
    return store.captures("c").select("url_key", "mime_type", F.col("ts").cast("timestamp_ntz").alias("ts"), F.md5("content").alias("digest"))


@query("store_catalog", "SELECT * FROM (VALUES ('a', 3::BIGINT, 0::BIGINT, TRUE), ('b', 2, 1, FALSE)) t(name, lines, drops, listed)")
def store_catalog(spark, sf_dir):
    store = Store(spark, _place(spark))
    store.create("a")
    store.create("b")
    store.drop("b")
    store.create("a", force=True)
    store.compact("a", "zstd")
    each = store.dump().groupBy("name").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(F.col("dropped"), 1)).alias("drops"))
    return each.join(store.collections().select("name", F.lit(True).alias("listed")), "name", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


_ONE = "(SELECT url, crawl_date, content FROM records WHERE crawl_date IS NOT NULL AND octet_length(encode(content)) <= 4000 AND url IN (SELECT url FROM records GROUP BY url HAVING count(*) = 1) ORDER BY url LIMIT 1)"


@query("resource_content", f"WITH {RECORDS_SQL} SELECT url, md5(content) AS digest FROM {_ONE}")
def resource_content(spark, sf_dir):
    r = records(spark, sf_dir)
    once = r.groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.max("crawl_date").alias("crawl_date"), F.max(F.octet_length("content")).alias("size"))
    one = once.filter("n = 1 AND crawl_date IS NOT NULL AND size <= 4000").orderBy("url").first()
    content = _stored(spark, sf_dir)[0].content("c", one.url, one.crawl_date + "000000")
    return spark.createDataFrame([(one.url, content)], "url string, content binary").select("url", F.md5("content").alias("digest"))


@query("id_range", "WITH ids AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS id FROM (SELECT DISTINCT url FROM pages)) SELECT min(id) AS first_id, max(id) AS last_id FROM ids WHERE url LIKE 'https://m.%'")
def id_range(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    ends = pages.filter("url LIKE 'https://m.%'").agg(F.min("url").alias("a"), F.max("url").alias("b")).first()
    return spark.createDataFrame([D.id_range(D.url_ids(pages), ends.a, ends.b)], "first_id long, last_id long")


@query("saved_dictionary", "SELECT url, row_number() OVER (ORDER BY url) - 1 AS id FROM (SELECT DISTINCT url FROM pages)")
def saved_dictionary(spark, sf_dir):
    at = _place(spark)
    D.save(D.url_ids(table(spark, sf_dir, "pages")), at)
    return D.load(spark, at)


_INDEXED = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query(
    "written_index",
    f"""WITH {RECORDS_SQL}, x AS (SELECT page_id, {TEXT_SQL.format(c='content')} AS text FROM records WHERE regexp_matches(url, '^https?://') AND NOT coalesce(regexp_matches(mime_type, '^(image|video|audio)/'), FALSE) AND length(content) <= 9000),
t AS (SELECT page_id, unnest({_INDEXED}) AS term FROM x), c AS (SELECT term, page_id, count(*) AS tf FROM t WHERE term NOT IN ({", ".join(f"'{w}'" for w in I.STOP_WORDS)}) GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM c GROUP BY term""",
)
def written_index(spark, sf_dir):
    at, r = _place(spark), I.indexable(records(spark, sf_dir), max_chars=9000)
    I.write_index(r.select("page_id", H.remove_html("content").alias("text")), "page_id", "text", at, shards=4, block=32)
    return I.read_index(spark, at).select("term", "df", F.inline("postings")).groupBy("term", "df").agg(F.sum("tf").alias("tf"))


@query("dated_page_texts", f"WITH {RECORDS_SQL} SELECT crawl_date, {TEXT_SQL.format(c='content')} AS text FROM records WHERE mime_type = 'text/html' AND crawl_date IS NOT NULL AND regexp_matches(url, '^https?://(m|blog)[.]')")
def dated_page_texts(spark, sf_dir):
    """The filter script: HTML pages with a date, of some hosts, without their headers and markup."""
    from crawlspan.functions.text import remove_http_header

    r = K.discard_date(K.keep_mime_types(records(spark, sf_dir), ["text/html"]), None)
    r = K.keep_url_patterns(r, ["https?://(m|blog)[.].*"])
    return r.select("crawl_date", H.remove_html(remove_http_header("content")).alias("text"))


_PROFILES = ", ".join(f"('{c}', '{g}', {k})" for c, p in lang.PROFILES.items() for g, k in p.items())


def _detected(texts: str, profiles: str) -> str:
    """CTEs from (id, text) to best(id, code): out-of-place distances of the commonest grams, NULL texts and those without letters left out."""
    grams = lambda src, key: f"""SELECT {key}, g, sum(n) AS n FROM (SELECT {key}, n, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: w[i:i]), list_transform(range(1, length(w)), lambda i: w[i:i+1]), list_transform(range(1, length(w) - 1), lambda i: w[i:i+2]))) AS g
  FROM (SELECT {key}, '_' || word || '_' AS w, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM {src}) GROUP BY ALL)) WHERE g <> '_' GROUP BY ALL"""  # noqa: E731
    rank = lambda key: f"row_number() OVER (PARTITION BY {key} ORDER BY n DESC, g) - 1"
    made = f"SELECT lang AS code, g, k FROM (SELECT *, {rank('lang')} AS k FROM ({grams(profiles, 'lang')})) WHERE k < {lang.SIZE}" if profiles else f"SELECT * FROM (VALUES {_PROFILES}) t(code, g, k)"
    return f"""p AS MATERIALIZED ({made}), m AS MATERIALIZED (SELECT * FROM (SELECT *, {rank('id')} AS k FROM ({grams(texts, 'id')})) WHERE k < {lang.SIZE}),
far AS (SELECT id, c.code, sum(coalesce(abs(m.k - p.k), {lang.SIZE})) AS d FROM m CROSS JOIN (SELECT DISTINCT code FROM p) c LEFT JOIN p ON p.code = c.code AND p.g = m.g GROUP BY id, c.code),
best AS (SELECT id, arg_min(code, (d, code)) AS code FROM far GROUP BY id)"""


@query("keep_languages", f"WITH {RECORDS_SQL}, texts AS (SELECT page_id AS id, {TEXT_SQL.format(c='content')} AS text FROM records), {_detected('texts', '')} SELECT page_id, url FROM records JOIN best ON page_id = id WHERE code IN ('en', 'fr')")
def keep_languages(spark, sf_dir):
    return K.keep_languages(records(spark, sf_dir), ["en", "fr"]).select("page_id", "url")


@query("discard_languages", f"WITH {RECORDS_SQL}, texts AS (SELECT page_id AS id, {TEXT_SQL.format(c='content')} AS text FROM records), {_detected('texts', '')} SELECT page_id, url FROM records JOIN best ON page_id = id WHERE code NOT IN ('en', 'fr')")
def discard_languages(spark, sf_dir):
    return K.discard_languages(records(spark, sf_dir), ["en", "fr"]).select("page_id", "url")


@query("document_languages", f"WITH texts AS (SELECT doc_id AS id, text, lang FROM documents), {_detected('texts', 'texts')} SELECT doc_id, coalesce(code, '') AS detected, lang FROM documents LEFT JOIN best ON doc_id = id")
def document_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", lang.detect_language(F.col("text"), lang.train_profiles(docs)).alias("detected"), "lang")


@query("capture_keys", f"WITH {RECORDS_SQL} SELECT page_id, {_KEY} AS url_key FROM records")
def capture_keys(spark, sf_dir):
    return records(spark, sf_dir).select("page_id", url_to_key("url").alias("url_key"))
