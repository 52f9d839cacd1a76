"""Queries over captures, images, entities, languages and the token index."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspan.functions import html as H
from crawlspan.functions import lang, media, ner
from crawlspan.functions import text as X
from crawlspan.functions.url import extract_domain, url_to_key
from crawlspan.operators import filters as K
from crawlspan.operators import images
from crawlspan.operators import index as I
from crawlspan.operators import store as S
from crawlspan.plans.registry import query, table
from crawlspan.plans.views import RECORDS_SQL, records
from crawlspan.sources import sinks

_KEY = "array_to_string(list_reverse(string_split(regexp_extract(url, '^https?://([^/:?#]*)', 1), '.')), '.') || regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1)"

#: Two versions of each dated page a month apart, the second of fewer pages.
CAPTURES_SQL = f"""{RECORDS_SQL},
caps AS (SELECT {_KEY} AS url_key, coalesce(mime_type, 'text/plain') AS mime_type, strptime(crawl_date, '%Y%m%d') AS ts, url, page_id FROM records WHERE crawl_date IS NOT NULL
  UNION ALL SELECT {_KEY}, coalesce(mime_type, 'text/plain'), strptime(crawl_date, '%Y%m%d') + INTERVAL 30 DAY, url, page_id FROM records WHERE crawl_date IS NOT NULL AND page_id % 3 = 0)"""


def captures(spark, sf_dir):
    r = records(spark, sf_dir).filter("crawl_date IS NOT NULL")
    first = r.select(url_to_key("url").alias("url_key"), F.coalesce("mime_type", F.lit("text/plain")).alias("mime_type"), F.to_timestamp("crawl_date", "yyyyMMdd").alias("ts"), "url", F.encode("content", "UTF-8").alias("content"), "page_id")
    return first.unionByName(first.filter("page_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAY")))




def _ntz():
    """ts without a zone, as SQL has it."""
    return F.col("ts").cast("timestamp_ntz").alias("ts")


@query("capture_upsert", f"WITH {CAPTURES_SQL} SELECT DISTINCT url_key, mime_type, ts FROM caps")
def capture_upsert(spark, sf_dir):
    c = captures(spark, sf_dir).drop("page_id")
    return S.upsert(c, c).select("url_key", "mime_type", _ntz())


@query("capture_ingest", f"WITH {RECORDS_SQL} SELECT {_KEY} AS url_key, coalesce(mime_type, 'text/plain') AS mime_type, octet_length(encode(content)) AS size FROM records WHERE page_id % 5 <> 0 AND octet_length(encode(content)) <= 4000")
def capture_ingest(spark, sf_dir):
    r = records(spark, sf_dir)
    raw = r.select("url", "mime_type", F.when(F.col("page_id") % 5 == 0, "request").when(F.col("page_id") % 5 == 1, "response").alias("record_type"), F.encode("content", "UTF-8").alias("content"), F.current_timestamp().alias("crawl_ts"))
    return S.to_captures(raw, 4000).select("url_key", "mime_type", F.octet_length("content").cast("long").alias("size"))


@query("capture_history", f"WITH {CAPTURES_SQL} SELECT ts, mime_type FROM caps WHERE url = (SELECT url FROM pages WHERE page_id = 3)")
def capture_history(spark, sf_dir):
    url = table(spark, sf_dir, "pages").filter("page_id = 3").first().url
    return S.history(captures(spark, sf_dir), url).select(_ntz(), "mime_type")


@query("capture_at", f"WITH {CAPTURES_SQL} SELECT url_key, ts FROM caps WHERE url = (SELECT url FROM pages WHERE page_id = 3) AND ts = TIMESTAMP '2008-05-04'")
def capture_at(spark, sf_dir):
    url = table(spark, sf_dir, "pages").filter("page_id = 3").first().url
    return S.at_instant(captures(spark, sf_dir), url, "20080504000000").select("url_key", _ntz())


@query(
    "closest_capture",
    f"""WITH {CAPTURES_SQL}, w AS (SELECT DISTINCT url_key, TIMESTAMP '2008-05-10' AS moment FROM caps)
SELECT url_key, ts, mime_type FROM (SELECT w.url_key, ts, mime_type, row_number() OVER (PARTITION BY w.url_key ORDER BY abs(epoch_us(ts) - epoch_us(moment)), ts, mime_type) AS k FROM w JOIN caps USING (url_key)) WHERE k = 1""",
)
def closest_capture(spark, sf_dir):
    c = captures(spark, sf_dir)
    wanted = c.select("url_key").distinct().withColumn("at", F.lit("2008-05-10").cast("timestamp"))
    return S.closest(c, wanted).select("url_key", _ntz(), "mime_type")


@query(
    "capture_page",
    f"""WITH {CAPTURES_SQL}, m AS (SELECT * FROM caps WHERE url = (SELECT url FROM pages WHERE page_id = 3) AND ts >= TIMESTAMP '2008-04-01')
SELECT row_number() OVER (ORDER BY ts, mime_type) AS n, ts, row_number() OVER (ORDER BY abs(epoch_us(ts) - epoch_us(TIMESTAMP '2008-05-01')), ts) = 1 AS is_closest FROM m""",
)
def capture_page(spark, sf_dir):
    url = table(spark, sf_dir, "pages").filter("page_id = 3").first().url
    return S.capture_query(captures(spark, sf_dir), url, begin="20080401", at="20080501000000").select(F.col("n").cast("long").alias("n"), _ntz(), "is_closest")


_TOKENS = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: t NOT IN (" + ", ".join(f"'{w}'" for w in I.STOP_WORDS) + "))"


@query("token_index", f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), c AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM c GROUP BY term")
def token_index(spark, sf_dir):
    x = I.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text", block=64)
    rows = x.select("term", "df", F.aggregate("postings", F.lit(0).cast("long"), lambda a, p: a + p["tf"]).alias("tf"), F.col("postings")[0]["key"].alias("a"), F.element_at("postings", -1)["key"].alias("b"))
    return rows.groupBy("term", "df").agg(F.sum("tf").alias("tf"), F.min("a").alias("first_doc"), F.max("b").alias("last_doc"))


@query("token_search", f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT doc_id AS key, count(*) AS score FROM t WHERE term IN ('est', 'en') GROUP BY 1 HAVING count(DISTINCT term) = 2")
def token_search(spark, sf_dir):
    return I.search(I.inverted_index(table(spark, sf_dir, "documents"), "doc_id", "text"), "est", "en")


@query("name_ngrams", "SELECT n_nationkey, unnest(list_concat(list_transform(range(1, length(n_name)), lambda i: lower(n_name)[i:i+1]), list_transform(range(1, length(n_name) - 1), lambda i: lower(n_name)[i:i+2]))) AS gram FROM nation")
def name_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(I.ngrams("n_name", 2, 3)).alias("gram"))


@query("word_shingles", "WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark) SELECT item_id, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS shingle FROM w WHERE len(w) >= 4")
def word_shingles(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(I.shingles(F.split("text", " "), 4, 4)).alias("shingle"))


_BMP = "'424D' || repeat('00', 16) || upper(lpad(hex(20 + page_id % 40), 2, '0')) || '000000' || '28000000'"


def _images(spark, sf_dir):
    width = F.lpad(F.hex(20 + F.col("page_id") % 40), 2, "0")
    data = F.unhex(F.concat(F.lit("424D" + "00" * 16), width, F.lit("000000" + "28000000")))
    return records(spark, sf_dir).withColumn("image_bytes", data).withColumn("mime_type", F.lit("image/bmp"))


@query("image_sizes", "SELECT page_id, CAST(20 + page_id % 40 AS INTEGER) AS width, 40 AS height, 'image/bmp' AS kind FROM pages WHERE 20 + page_id % 40 >= 30")
def image_sizes(spark, sf_dir):
    r = _images(spark, sf_dir)
    return K.large_enough(r.select("page_id", F.inline(F.array(media.image_size("image_bytes"))), media.detect_mime("image_bytes").alias("kind")).select("page_id", "width", "height", "kind"))


@query(
    "popular_images",
    f"""WITH {RECORDS_SQL} SELECT url, n AS "count" FROM (SELECT min(url) AS url, count(*) AS n FROM records WHERE crawl_date IS NOT NULL AND page_id % 40 >= 10 GROUP BY page_id % 40) ORDER BY n DESC, url LIMIT 5""",
)
def popular_images(spark, sf_dir):
    return images.popular_images(_images(spark, sf_dir), 5)


@query("page_entities")
def page_entities(spark, sf_dir):
    r = records(spark, sf_dir).filter("crawl_date IS NOT NULL")
    rows = r.select(F.col("crawl_date").alias("date"), "url", H.remove_html("content").alias("content"))
    return ner.entity_rows(ner.extract_entities(rows))


@query(
    "gdf_lines",
    """WITH e AS (SELECT 'n' || (o_custkey % 9) AS src, 'n' || (o_orderkey % 7) AS dst, strftime(o_orderdate, '%Y') AS date, count(*) AS n FROM orders GROUP BY ALL)
SELECT 0 AS part, 'nodedef> name VARCHAR' AS line UNION ALL SELECT DISTINCT 1, x FROM (SELECT src AS x FROM e UNION SELECT dst FROM e)
UNION ALL SELECT 2, 'edgedef> source VARCHAR,target VARCHAR,weight DOUBLE,timeint VARCHAR' UNION ALL SELECT 3, src || ',' || dst || ',' || n || ',' || date FROM e""",
)
def gdf_lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = lambda c, k: F.concat(F.lit("n"), (F.col(c) % k).cast("string"))
    e = o.groupBy(name("o_custkey", 9).alias("src"), name("o_orderkey", 7).alias("dst"), F.date_format("o_orderdate", "yyyy").alias("date")).agg(F.count(F.lit(1)).alias("count"))
    return sinks.gdf_lines(e)


@query("event_days", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1")
def event_days(spark, sf_dir):
    from crawlspan.streaming.crawl import pages_by_day

    return pages_by_day(table(spark, sf_dir, "events"), ts="ts").select(F.col("day").cast("timestamp_ntz").alias("day"), "n")


@query("domain_languages", "SELECT regexp_extract(url, '^https?://([^/:?#]*)', 1) AS domain, regexp_extract(url, '^https?://[^/]*/([a-z]{2})/', 1) AS lang, count(*) AS n FROM pages GROUP BY ALL")
def domain_languages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(extract_domain("url").alias("domain"), F.regexp_extract("url", "^https?://[^/]*/([a-z]{2})/", 1).alias("lang"))
    return p.groupBy("domain", "lang").agg(F.count(F.lit(1)).alias("n"))
