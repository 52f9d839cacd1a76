"""Crawl files written here and read back, whole and broken."""

import gzip
import io

import pytest

from crawlspan.operators import filters
from crawlspan.sources import archive, codec, text

HTML = b"<html><body><a href='/x'>x</a> <a href=\"http://b.org/\">b &amp; c</a></body></html>"
PNG = b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + (40).to_bytes(4, "big") + (30).to_bytes(4, "big") + bytes(5)
OK = b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\n\r\n%s"


def arc_records():
    R = lambda url, mime, content: codec.Record("ARC", None, url, "1.2.3.4", "20080430204825", mime, len(content), content)
    return [
        R("filedesc://mini.arc", "text/plain", b"1 0 test\n"),
        R("dns:example.org", "text/dns", b"1.2.3.4"),
        R("http://example.org/robots.txt", "text/html", OK % (b"text/html", b"none")),
        R("http://www.example.org/", "text/html", OK % (b"text/html", HTML)),
        R("http://example.org/a.png", "image/png", OK % (b"image/png", PNG)),
        R("http://example.org/é?q=1", "text/plain", OK % (b"text/plain", b"caf\xe9 \xff")),
    ]


def warc_records():
    R = lambda kind, url, content, date="2008-04-30T20:48:25Z": codec.Record("WARC", kind, url, None, date, None, len(content), content)
    return [
        R("warcinfo", None, b"software: x\r\n"),
        R("request", "http://www.example.org/", b"GET / HTTP/1.1\r\n\r\n"),
        R("response", "http://www.example.org/", OK % (b"text/html;", HTML)),
        R("response", "http://example.org/a.png", b"HTTP/1.1 200 OK\r\ncontent-type: image/png\r\n\r\n" + PNG, "2008-05-01T01:00:00+02:00"),
        R("response", "http://example.org/none", b"HTTP/1.1 204\r\n\r\n"),
        R("metadata", "http://example.org/none", b"x"),
    ]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("crawl")
    codec.write(f"{d}/mini.arc.gz", arc_records())
    codec.write(f"{d}/mini.warc.gz", warc_records())
    codec.write(f"{d}/plain.warc", warc_records(), packed=False)
    return d


@pytest.mark.parametrize("r", arc_records() + warc_records())
def test_bytes_round_trip(r):
    back = codec.from_bytes(codec.to_bytes(r))
    assert (back.url, back.date, back.content, back.record_type, back.length) == (r.url, r.date, r.content, r.record_type, r.length)


def test_loaders(spark, folder):
    arc = archive.load_arc(spark, f"{folder}/mini.arc.gz").collect()
    assert [r.url for r in arc] == [r.url for r in arc_records()]
    page = arc[3]
    assert (page.crawl_date, page.crawl_month, page.domain, page.mime_type) == ("20080430", "200804", "www.example.org", "text/html")
    assert page.content_bytes == HTML and page.image_bytes == HTML and "�" in arc[5].content
    warc = archive.load_warc(spark, f"{folder}/mini.warc.gz").collect()
    assert [(r.url, r.mime_type, r.crawl_date) for r in warc] == [("http://www.example.org/", "text/html", "20080430"), ("http://example.org/a.png", "image/png", "20080430"), ("http://example.org/none", None, "20080430")]
    assert warc[1].image_bytes == PNG and warc[0].content_bytes.startswith(b"HTTP/")
    assert archive.load_archives(spark, str(folder)).count() == 6 + 3 + 3
    assert archive.read(spark, str(folder)).groupBy("record_type").count().filter("record_type = 'request'").first()["count"] == 2


def test_pushdown(spark, folder):
    raw = archive.read(spark, f"{folder}/*.warc*")
    assert raw.filter("record_type = 'metadata'").count() == 2 and raw.filter("url = 'http://example.org/none' and format = 'WARC'").count() == 4
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    try:
        assert archive.read(spark, f"{folder}/*.warc*").filter("record_type = 'metadata'").count() == 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_broken_files(spark, tmp_path):
    whole = b"".join(gzip.compress(codec.to_bytes(r)) for r in warc_records())
    last = gzip.compress(codec.to_bytes(warc_records()[-1]))
    (tmp_path / "cut.warc.gz").write_bytes(whole[: -len(last) // 2])
    assert archive.read(spark, f"{tmp_path}/cut.warc.gz").count() == 5
    with pytest.raises(Exception, match="Malformed|end-of-stream|ends after"):
        archive.read(spark, f"{tmp_path}/cut.warc.gz", mode="FAILFAST").collect()
    plain = [codec.to_bytes(r) for r in warc_records()]
    (tmp_path / "dirty.warc").write_bytes(plain[0] + b"garbage\r\n" + plain[2])
    assert archive.read(spark, f"{tmp_path}/dirty.warc").count() == 1
    assert archive.read(spark, f"{tmp_path}/dirty.warc", mode="DROPMALFORMED").count() == 2
    negative = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://x.org/\r\nContent-Length: -5\r\n\r\n\r\n\r\n"
    assert next(codec.read(io.BufferedReader(io.BytesIO(negative)))).content == b""
    (tmp_path / "empty.arc").write_bytes(b"")
    assert archive.read(spark, f"{tmp_path}/empty.arc").count() == 0


def test_finders(spark, folder):
    raw = archive.read(spark, str(folder))
    assert archive.find_urls(raw, "http://example[.]org/.*png").count() == 3
    found = archive.search_url(raw, "http://www.example.org/").collect()
    assert len(found) == 5 and {r.url_key for r in found} == {"org.example.www/"}


def test_valid_pages_over_files(spark, folder):
    pages = filters.keep_valid_pages(archive.load_archives(spark, str(folder)))
    assert sorted(r.url for r in pages.collect()) == ["http://www.example.org/"] * 3


def test_line_sources(spark, tmp_path):
    (tmp_path / "tweets.json").write_text('{"id_str":"1","user":{"followers_count":3}}\n{"delete":{"x":1}}\nnot json\n{"id_str":"2"}\n')
    assert text.load_tweets(spark, f"{tmp_path}/tweets.json").count() == 2
    (tmp_path / "scrape.txt").write_text("(20080430,http://a.org/,one, two, three)\nbroken\n(20080501,http://b.org/,x)\n")
    rows = text.load_scrape(spark, f"{tmp_path}/scrape.txt").collect()
    assert [tuple(r) for r in rows] == [("20080430", "http://a.org/", "one, two, three"), ("20080501", "http://b.org/", "x")]
    assert text.parse_triples(spark.createDataFrame([("a,b,c,d",), ("a",)], "value string")).collect()[0].content == "c,d"
    (tmp_path / "p.csv").write_text("id,url\n1,http://a.org/\n2\n3,http://b.org/\n")
    assert {r.prefix_id for r in text.load_prefixes(spark, f"{tmp_path}/p.csv").collect()} == {1, 3}
    (tmp_path / "urls.txt").write_text("http://a.org/ 12\n\n  http://b.org/\n")
    assert [r.url for r in text.load_url_list(spark, f"{tmp_path}/urls.txt").collect()] == ["http://a.org/", "http://b.org/"]
