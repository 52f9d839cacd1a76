"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspan.functions import text as X
from crawlspan.functions import tweet as W
from crawlspan.functions import url as U
from crawlspan.plans.registry import query, table
from crawlspan.plans.views import RECORDS_SQL, records


@query(
    "date_components",
    f"""WITH {RECORDS_SQL} SELECT page_id, substring(crawl_date, 1, 4) AS yyyy, substring(crawl_date, 5, 2) AS mm, substring(crawl_date, 7, 2) AS dd,
  substring(crawl_date, 1, 6) AS yyyymm, substring(crawl_date, 1, 8) AS yyyymmdd FROM records""",
)
def date_components(spark, sf_dir):
    return records(spark, sf_dir).select("page_id", *[X.extract_date("crawl_date", c).alias(c.name.lower()) for c in X.DateComponent])


@query(
    "extract_domain",
    "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]*)', 1) AS domain, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^https?://([^/:?#]*)', 1) END AS fallback FROM pages",
)
def extract_domain(spark, sf_dir):
    bad = F.when(F.col("page_id") % 3 == 0, F.lit("index.html"))
    return table(spark, sf_dir, "pages").select("page_id", U.extract_domain("url").alias("domain"), U.extract_domain(bad, F.col("url")).alias("fallback"))


@query("remove_www", "SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/:?#]*)', 1), '^\\s*www\\.', '') AS site FROM pages")
def remove_www(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.remove_www(U.host("url")).alias("site"))


_TAGS = {"extract_hashtags": ("#[^ ]+", X.extract_hashtags), "extract_mentions": ("@[A-Za-z_0-9]+", X.extract_mentions)}
for _name, (_pattern, _f) in _TAGS.items():

    @query(_name, f"SELECT doc_id, unnest(regexp_extract_all(text, '{_pattern}')) AS found FROM documents")
    def tags(spark, sf_dir, f=_f):
        return table(spark, sf_dir, "documents").select("doc_id", F.explode(f("text")).alias("found"))


@query("extract_urls", "SELECT page_id, unnest(regexp_extract_all('see ' || url || ' and ' || url || '/x, ok', 'https?://[^ ]+')) AS found FROM pages")
def extract_urls(spark, sf_dir):
    text = F.concat(F.lit("see "), "url", F.lit(" and "), "url", F.lit("/x, ok"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(X.extract_urls(text)).alias("found"))


@query(
    "remove_http_header",
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN 'HTTP/1.1 200 OK' ELSE html END AS body FROM pages""",
)
def remove_http_header(spark, sf_dir):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"), "html")).when(k == 1, F.lit("HTTP/1.1 200 OK")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", X.remove_http_header(raw).alias("body"))


@query("warc_mime", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' END AS mime FROM pages")
def warc_mime(spark, sf_dir):
    k = F.col("page_id") % 3
    head = F.when(k == 0, "HTTP/1.1 200 OK\r\ncontent-type: text/html; charset=utf-8\r\n\r\n").when(k == 1, "HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n").otherwise("HTTP/1.1 204\r\n\r\n")
    return table(spark, sf_dir, "pages").select("page_id", X.warc_mime(head).alias("mime"))


@query("md5_hex", "SELECT doc_id, md5(text) AS digest FROM documents")
def md5_hex(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.md5_hex("text").alias("digest"))


_KEY = """regexp_extract(url, '^https?://([^/:?#]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS file"""
_REV = "array_to_string(list_reverse(string_split(host, '.')), '.')"


@query("url_to_key", f"WITH p AS (SELECT page_id, {_KEY} FROM pages) SELECT page_id, {_REV} || file AS url_key FROM p")
def url_to_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.url_to_key("url").alias("url_key"))


@query("key_to_url", f"WITH p AS (SELECT page_id, {_KEY} FROM pages) SELECT page_id, 'http://' || host || file AS back, {_REV} AS key_domain, {_REV} || ':8080' AS reversed FROM p")
def key_to_url(spark, sf_dir):
    key = U.url_to_key("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.key_to_url(key).alias("back"), U.key_domain(key).alias("key_domain"), U.reverse_hostname(F.concat(U.host("url"), F.lit(":8080"))).alias("reversed")
    )


@query(
    "file_type",
    """WITH p AS (SELECT page_id, string_split(url, '/')[-1] AS last FROM pages)
SELECT page_id, CASE WHEN NOT contains(last, '.') OR length(string_split(last, '.')[-1]) > 8 OR regexp_full_match(string_split(last, '.')[-1], '[0-9]') THEN ''
  ELSE string_split(last, '.')[-1] END AS kind FROM p""",
)
def file_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.file_type("url").alias("kind"))


@query(
    "instants",
    f"""WITH {RECORDS_SQL} SELECT page_id, crawl_date || '123456' AS digits, strptime(crawl_date || '123456', '%Y%m%d%H%M%S') AS instant FROM records""",
)
def instants(spark, sf_dir):
    ts = X.parse_instant(F.concat("crawl_date", F.lit("123456")))
    return records(spark, sf_dir).select("page_id", X.format_instant(ts).alias("digits"), ts.cast("timestamp_ntz").alias("instant"))


@query(
    "text_excerpts",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(substring(CASE WHEN regexp_matches(text, '\\s')
  THEN regexp_extract(text, '(?s)^(\\S*)\\s+', 1) || regexp_extract(text, '(?s)^\\S*\\s+(.*)$', 1) ELSE text END, 1, 100), '[\\n\\r]+', '', 'g') END AS excerpt FROM documents""",
)
def text_excerpts(spark, sf_dir):
    mime = F.when(F.col("doc_id") % 2 == 0, "text/html").otherwise("image/png")
    return table(spark, sf_dir, "documents").select("doc_id", X.excerpt("text", mime).alias("excerpt"))


@query(
    "labels_and_scales",
    """SELECT o_orderkey, substring(strftime(o_orderdate, '%Y%m'), 3, 2) || '/' || substring(strftime(o_orderdate, '%Y%m'), 5, 2) AS label,
  CASE WHEN length(o_orderpriority || ' of the orders') > 20 THEN substring(o_orderpriority || ' of the orders', 1, 20) || '...' ELSE o_orderpriority || ' of the orders' END AS short,
  round(ln(o_orderkey + 1), 6) AS strength, round(1 + 0.5 * ln(o_orderkey + 1) * 20, 6) AS radius FROM orders""",
)
def labels_and_scales(spark, sf_dir):
    n = F.col("o_orderkey") + 1
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        X.crawl_label(F.date_format("o_orderdate", "yyyyMM")).alias("label"),
        X.short_label(F.concat("o_orderpriority", F.lit(" of the orders"))).alias("short"),
        F.round(X.log_strength(n), 6).alias("strength"),
        F.round(X.node_radius(F.lit(0.5), n), 6).alias("radius"),
    )


@query(
    "tab_delimited",
    "SELECT concat_ws(chr(9), n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN 'null' ELSE n_regionkey::VARCHAR END, n_regionkey) AS value FROM nation",
)
def tab_delimited(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    nested = n.select(F.struct(F.struct("n_nationkey", "n_name").alias("a"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("b")).alias("k"), "n_regionkey")
    return X.tab_delimit(nested)


def tweets(spark, sf_dir):
    """Tweet JSON made of conversations, with delete notices and broken lines among them."""
    c = table(spark, sf_dir, "conversations")
    user = F.struct(F.concat("role", F.col("conv_id").cast("string")).alias("screen_name"), F.col("turn").cast("int").alias("followers_count"), (F.col("turn") % 2 == 0).alias("verified"))
    json = F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id_str"), F.lit("Mon Apr 07 10:00:00 +0000 2008").alias("created_at"), "text", F.lit("en").alias("lang"), user.alias("user")))
    k = F.col("conv_id") % 10
    return c.select(F.when(k == 1, F.concat(F.lit('{"delete":'), json, F.lit("}"))).when(k == 2, F.substring(json, 1, 20)).otherwise(json).alias("value"))


@query(
    "tweet_fields",
    """SELECT conv_id || '-' || turn AS id, 'Mon Apr 07 10:00:00 +0000 2008' AS created_at, text, 'en' AS lang, role || conv_id AS username,
  turn % 2 = 0 AS verified, CAST(turn AS INTEGER) AS followers, 0 AS friends FROM conversations WHERE conv_id % 10 NOT IN (1, 2)""",
)
def tweet_fields(spark, sf_dir):
    from crawlspan.sources.text import parse_tweets

    t = F.col("tweet")
    return parse_tweets(tweets(spark, sf_dir)).select(
        W.tweet_id(t).alias("id"), W.created_at(t).alias("created_at"), W.tweet_text(t).alias("text"), W.lang(t).alias("lang"), W.username(t).alias("username"),
        W.is_verified(t).alias("verified"), W.follower_count(t).alias("followers"), W.friend_count(t).alias("friends"),
    )


@query("json_round_trip", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS missing FROM nation")
def json_round_trip(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(X.to_json("n_nationkey", "n_name", "n_regionkey").alias("j"))
    return n.select(X.from_json("j", "n_nationkey int, n_name string, missing string").alias("x")).select("x.*")


@query(
    "record_maps",
    f"""WITH {RECORDS_SQL} SELECT url, crawl_date AS date, concat_ws(chr(9), url, crawl_date, mime_type) AS meta,
  CASE WHEN mime_type = 'text/html' THEN length(content) END AS html_length FROM records""",
)
def record_maps(spark, sf_dir):
    r = records(spark, sf_dir)
    html = F.when(F.col("mime_type") == "text/html", F.create_map(F.lit("url"), "url", F.lit("html"), "content"))
    meta = F.create_map(F.lit("url"), "url", F.lit("date"), "crawl_date", F.lit("mime-type"), "mime_type")
    m = r.select(meta.alias("m"), html.alias("h"))
    return m.select(F.col("m")["url"].alias("url"), F.col("m")["date"].alias("date"), F.concat_ws("\t", F.map_values("m")).alias("meta"), F.length(F.col("h")["html"]).cast("long").alias("html_length"))
