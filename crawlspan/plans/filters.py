"""Queries over the record filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlspan.functions.text import DateComponent
from crawlspan.functions.url import extract_domain, remove_www
from crawlspan.operators import filters as ops
from crawlspan.operators.aggregate import count_items
from crawlspan.plans.registry import query
from crawlspan.plans.views import RECORDS_SQL, records

VALID_SQL = """crawl_date IS NOT NULL
  AND (coalesce(mime_type IN ('text/html', 'application/xhtml+xml'), FALSE) OR url LIKE '%htm' OR url LIKE '%html')
  AND NOT url LIKE '%robots.txt'"""


@query(
    "pages_by_domain",
    f"""WITH {RECORDS_SQL}
SELECT regexp_replace(regexp_extract(url, '^https?://([^/:?#]*)', 1), '^\\s*www\\.', '') AS domain, count(*) AS "count"
FROM records WHERE {VALID_SQL} GROUP BY 1""",
)
def pages_by_domain(spark, sf_dir):
    r = records(spark, sf_dir).transform(ops.keep_valid_pages)
    return count_items(r.select(remove_www(extract_domain(F.col("url"))).alias("domain")), "domain")


_HOST = "regexp_extract(url, '^https?://([^/:?#]*)', 1)"
_ROW = "page_id, url, mime_type, crawl_date"


def _filter(name: str, where: str, f, columns: str = _ROW):
    """A filter over the records view: its rows without the content."""

    @query(name, f"WITH {RECORDS_SQL} SELECT {columns} FROM records WHERE {where}")
    def run(spark, sf_dir):
        return f(records(spark, sf_dir)).select(*columns.split(", "))

    return run


_TYPES = ["text/plain", "image/png"]
_SOME_URL = "https?://www[.].*/en/.*"
_SOME_TEXT = ["<b>The ", "charset=\"utf-8\"><title>An"]
_DOMAIN = "blog.tionsh.example.net"

_filter("keep_valid_pages", VALID_SQL, ops.keep_valid_pages)
_filter("keep_images", "crawl_date IS NOT NULL AND (coalesce(contains(mime_type, 'image/'), FALSE) OR regexp_matches(url, '(jpg|jpeg|png)$')) AND NOT url LIKE '%robots.txt'", ops.keep_images)
_filter("keep_mime_types", "mime_type IN ('text/plain', 'image/png')", lambda r: ops.keep_mime_types(r, _TYPES))
_filter("discard_mime_types", "NOT coalesce(mime_type IN ('text/plain', 'image/png'), FALSE)", lambda r: ops.discard_mime_types(r, _TYPES))
_filter("keep_date", "crawl_date = '20080410'", lambda r: ops.keep_date(r, "20080410"))
_filter("keep_month", "substring(crawl_date, 1, 6) = '200805'", lambda r: ops.keep_date(r, "200805", DateComponent.YYYYMM))
_filter("keep_undated", "crawl_date IS NULL", lambda r: ops.keep_date(r, None))
_filter("discard_date", "crawl_date IS DISTINCT FROM '20080410'", lambda r: ops.discard_date(r, "20080410"))
_filter("discard_undated", "crawl_date IS NOT NULL", lambda r: ops.discard_date(r, None))
_filter("keep_date_range", "crawl_date BETWEEN '20080405' AND '20080502'", lambda r: ops.keep_date_range(r, "20080405", "20080502"))
_filter("keep_date_from", "crawl_date >= '20080502'", lambda r: ops.keep_date_range(r, begin="20080502"))
_filter("keep_url_patterns", f"regexp_full_match(url, '{_SOME_URL}')", lambda r: ops.keep_url_patterns(r, [_SOME_URL, "nothing"]))
_filter("discard_url_patterns", f"NOT regexp_full_match(url, '{_SOME_URL}')", lambda r: ops.discard_url_patterns(r, [_SOME_URL, "nothing"]))
_filter("keep_domains", f"{_HOST} = '{_DOMAIN}'", lambda r: ops.keep_domains(r, [_DOMAIN]))
_filter("keep_domains_without_www", f"regexp_replace({_HOST}, '^www\\.', '') = 'ththhe.example.com'", lambda r: ops.keep_domains(r, ["ththhe.example.com"], strip_www=True))
_filter("discard_domains", f"{_HOST} <> '{_DOMAIN}'", lambda r: ops.discard_domains(r, [_DOMAIN]))
_filter("keep_content", "content LIKE '%<b>The %' OR content LIKE '%charset=\"utf-8\"><title>An%'", lambda r: ops.keep_content(r, _SOME_TEXT))
_filter("discard_content", "NOT (content LIKE '%<b>The %' OR content LIKE '%charset=\"utf-8\"><title>An%')", lambda r: ops.discard_content(r, _SOME_TEXT))
_filter("keep_http", "url LIKE 'http://%'", ops.keep_http)
_filter("keep_html_type", "mime_type = 'text/html'", lambda r: ops.keep_mime_types(r, ["text/html"]))


@query("keep_known_urls", f"WITH {RECORDS_SQL} SELECT {_ROW} FROM records WHERE url IN (SELECT url FROM pages WHERE regexp_matches(url, '#top$'))")
def keep_known_urls(spark, sf_dir):
    r = records(spark, sf_dir)
    return ops.keep_known(r, r.filter("url rlike '#top$'")).select(*_ROW.split(", "))


#: Addresses that may or may not stand in the tables: a list that becomes literals, and one that is joined.
_ASKED = {
    "few": (["https"], ["blog.tionsh.example.net"], ["#top"]),
    "many": (["http", "https"], ["blog.tionsh.example.net", "thther.example.org", "ththre.example.com", "www.therti.example.org", "thther.example.com"], ["", "#top", ".html", "/"]),
}


def _asked(name: str) -> list[str]:
    schemes, hosts, endings = _ASKED[name]
    return [f"{p}://{h}/en/{k}{e}" for p in schemes for h in hosts for k in range(1000) for e in endings]


for _name, _parts in _ASKED.items():
    _lists = ", ".join(f"(VALUES {', '.join(f'({v!r})' for v in values)}) {t}(v)" for t, values in zip("phe", _parts))
    _set = f"(SELECT p.v || '://' || h.v || '/en/' || c.k || e.v FROM {_lists}, range(1000) c(k))"
    _filter(f"keep_{_name}_urls", f"url IN {_set}", lambda r, n=_name: ops.keep_urls(r, _asked(n)))
    _filter(f"discard_{_name}_urls", f"url NOT IN {_set}", lambda r, n=_name: ops.discard_urls(r, [*_asked(n), None]))
