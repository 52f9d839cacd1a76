"""Record filters, each DataFrame -> DataFrame for use with `df.transform`.

A keep filter drops rows whose tested column is NULL and the discard filter of
the same name keeps them, so that the two always partition their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_TYPES = ("text/html", "application/xhtml+xml")


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def valid_page(date: str = "crawl_date", mime: str = "mime_type", url: str = "url") -> Column:
    u = F.col(url)
    return F.col(date).isNotNull() & (_true(F.col(mime).isin(*PAGE_TYPES)) | _true(u.endswith("htm") | u.endswith("html"))) & ~_true(u.endswith("robots.txt"))


def keep_valid_pages(df: DataFrame) -> DataFrame:
    """Dated HTML pages, by MIME type or URL ending, that aren't robots.txt."""
    return df.filter(valid_page())


def valid_image(date: str = "crawl_date", mime: str = "mime_type", url: str = "url") -> Column:
    u = F.col(url)
    named = u.endswith("jpg") | u.endswith("jpeg") | u.endswith("png")
    return F.col(date).isNotNull() & (_true(F.col(mime).contains("image/")) | _true(named)) & ~_true(u.endswith("robots.txt"))


def keep_images(df: DataFrame) -> DataFrame:
    """Dated images, by MIME type or a jpg, jpeg or png ending; a GIF passes by its MIME type alone."""
    return df.filter(valid_image())


def member(column: Column, values) -> Column:
    """Two-valued membership; None among the values matches NULL."""
    values = list(values)
    known = [v for v in values if v is not None]
    hit = _true(column.isin(*known)) if known else F.lit(False)
    return hit | column.isNull() if None in values else hit


#: More literals than this are joined instead of listed.
MANY = 1000


def _member(df: DataFrame, column: str, values, keep: bool) -> DataFrame:
    values = list(values)
    if len(values) <= MANY:
        hit = member(F.col(column), values)
        return df.filter(hit if keep else ~hit)
    wanted = df.sparkSession.createDataFrame([(v,) for v in sorted({v for v in values if v is not None})], f"_v {df.schema[column].dataType.simpleString()}")
    joined = df.join(wanted, F.col(column) == F.col("_v"), "left_semi" if keep else "left_anti")
    if None in values:
        return joined.unionByName(df.filter(F.col(column).isNull())) if keep else joined.filter(F.col(column).isNotNull())
    return joined


def keep_mime_types(df: DataFrame, types) -> DataFrame:
    return _member(df, "mime_type", types, True)


def discard_mime_types(df: DataFrame, types) -> DataFrame:
    return _member(df, "mime_type", types, False)


def keep_date(df: DataFrame, date: str | None, component=None) -> DataFrame:
    """Records whose date component equals `date`; None keeps those without a date."""
    from crawlspan.functions.text import DateComponent, extract_date

    return df.filter(extract_date("crawl_date", component or DateComponent.YYYYMMDD).eqNullSafe(date))


def discard_date(df: DataFrame, date: str | None) -> DataFrame:
    """Records of another date; None keeps those that have one."""
    return df.filter(~F.col("crawl_date").eqNullSafe(date))


def keep_date_range(df: DataFrame, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Dates from `begin` to `end`, both included and optional."""
    if begin is not None:
        df = df.filter(F.col("crawl_date") >= begin)
    return df if end is None else df.filter(F.col("crawl_date") <= end)


def keep_urls(df: DataFrame, urls) -> DataFrame:
    return _member(df, "url", urls, True)


def discard_urls(df: DataFrame, urls) -> DataFrame:
    return _member(df, "url", urls, False)


def _any(column: Column, patterns, whole: bool) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | _true(column.rlike(f"^(?:{p})$" if whole else p))
    return hit


def keep_url_patterns(df: DataFrame, patterns) -> DataFrame:
    """URLs that one of the patterns matches from end to end."""
    return df.filter(_any(F.col("url"), patterns, True))


def discard_url_patterns(df: DataFrame, patterns) -> DataFrame:
    return df.filter(~_any(F.col("url"), patterns, True))


def _domain(strip_www: bool) -> Column:
    from crawlspan.functions.url import host, remove_www

    return remove_www(host("url")) if strip_www else host("url")


def keep_domains(df: DataFrame, domains, strip_www: bool = False) -> DataFrame:
    """Exact hosts; with strip_www, `www.` doesn't count."""
    return df.filter(member(_domain(strip_www), domains))


def discard_domains(df: DataFrame, domains, strip_www: bool = False) -> DataFrame:
    return df.filter(~member(_domain(strip_www), domains))


def keep_content(df: DataFrame, patterns) -> DataFrame:
    """Content in which one of the patterns is found."""
    return df.filter(_any(F.col("content"), patterns, False))


def discard_content(df: DataFrame, patterns) -> DataFrame:
    return df.filter(~_any(F.col("content"), patterns, False))


def keep_languages(df: DataFrame, languages) -> DataFrame:
    """Records whose text, without markup, is in one of the languages."""
    from crawlspan.functions.html import remove_html
    from crawlspan.functions.lang import detect_language

    return df.filter(member(detect_language(remove_html("content")), languages))


def discard_languages(df: DataFrame, languages) -> DataFrame:
    from crawlspan.functions.html import remove_html
    from crawlspan.functions.lang import detect_language

    return df.filter(~member(detect_language(remove_html("content")), languages))


def keep_http(df: DataFrame) -> DataFrame:
    """http:// alone, without https."""
    return df.filter(F.col("url").startswith("http://"))


def keep_known(df: DataFrame, url_ids: DataFrame) -> DataFrame:
    """URLs that the dictionary (url, id) holds."""
    return df.join(url_ids.select("url"), "url", "left_semi")


def linked(df: DataFrame, src: str = "src", dst: str = "dst", empty: bool = False) -> DataFrame:
    """Links with both ends; '' counts as an end only if `empty`."""
    df = df.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    return df if empty else df.filter((F.col(src) != "") & (F.col(dst) != ""))


def large_enough(df: DataFrame, min_width: int = 30, min_height: int = 30) -> DataFrame:
    return df.filter((F.col("width") >= min_width) & (F.col("height") >= min_height))


MAX_BYTES = 10 << 20


def ingestible(df: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Rows (record_type, url, url_key, mime_type, content) that ingest takes, MIME type text/plain by default.

    Dropped: ARC version blocks and dns: records, WARC records that are no
    responses, URLs without a key, and content over `max_bytes`.
    """
    fits = F.octet_length("content") <= max_bytes
    response = F.col("record_type").isNull() | (F.col("record_type") == "response")
    plain = ~F.col("url").startswith("dns:") & ~F.col("url").startswith("filedesc:")
    return df.filter(response & plain & F.col("url_key").isNotNull() & fits).withColumn("mime_type", F.coalesce("mime_type", F.lit("text/plain")))
