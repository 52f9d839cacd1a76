"""Column functions on the reference cases and beyond."""

import random

import pytest
from pyspark.sql import functions as F

from crawlspan.functions import html as H
from crawlspan.functions import lang, media, ner
from crawlspan.functions import text as X
from crawlspan.functions import url as U


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "url, source, host",
    [
        ("https://github.com/x/y", None, "github.com"),
        ("index.html", None, None),
        ("index.html", "http://seq.example.ca/a", "seq.example.ca"),
        ("bad", "bad", None),
        (None, "http://a.org", None),
        ("mailto:a@b.c", None, ""),
        ("HTTP://user:pw@Foo_bar.com:8080/a|b", None, "Foo_bar.com"),
        ("http://ex.com?x=http://y.org", None, "ex.com"),
    ],
)
def test_domain(spark, url, source, host):
    df = spark.createDataFrame([(url, source)], "u string, s string")
    assert df.select(U.extract_domain("u", "s")).first()[0] == host


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.house.gov/mthompson/the_1st_district.htm", "gov.house.www/mthompson/the_1st_district.htm"),
        ("http://foo.bar.com:8080/a?b=c#d", "com.bar.foo:8080/a?b=c"),
        ("not a url", None),
        (None, None),
    ],
)
def test_url_key(spark, url, key):
    assert one(spark, url, U.url_to_key) == key
    if key and ":" not in key:
        assert one(spark, key, U.key_to_url) == url


@pytest.mark.parametrize("host, back", [("foo.bar.com", "com.bar.foo"), ("foo.bar.com:8080", "com.bar.foo:8080"), ("com", "com"), ("", "")])
def test_reverse(spark, host, back):
    assert one(spark, host, U.reverse_hostname) == back and one(spark, back, U.reverse_hostname) == host


@pytest.mark.parametrize("url, kind", [("http://a/b.html", "html"), ("http://a.org/", ""), ("http://a/b", ""), ("http://a/b.verylongsuffix", ""), ("http://a/v1.5", ""), ("x.tar.gz", "gz")])
def test_file_type(spark, url, kind):
    assert one(spark, url, U.file_type) == kind


def test_bare_key(spark):
    assert one(spark, "com.example", U.key_to_url) == "example.com"


def test_dates(spark):
    got = [one(spark, "20151204", lambda c, k=k: X.extract_date(c, k)) for k in X.DateComponent]
    assert got == ["2015", "12", "04", "201512", "20151204"]
    assert one(spark, None, X.extract_date) is None and one(spark, "2015", lambda c: X.extract_date(c, X.DateComponent.MM)) == ""


@pytest.mark.parametrize("text, body", [("HTTP/1.1 200\r\nA: b\r\n\r\nbody\r\n\r\nmore", "body\r\n\r\nmore"), ("HTTP/1.1 200", "HTTP/1.1 200"), ("plain\r\n\r\nx", "plain\r\n\r\nx"), (None, None)])
def test_http_header(spark, text, body):
    assert one(spark, text, X.remove_http_header) == body


def test_patterns(spark):
    tweet = "see http://t.co/a and https://x.org/b?c #One #two, @me @you_2 @x-y http:/bad"
    assert one(spark, tweet, X.extract_urls) == ["http://t.co/a", "https://x.org/b?c"]
    assert one(spark, tweet, X.extract_hashtags) == ["#One", "#two,"] and one(spark, tweet, X.extract_mentions) == ["@me", "@you_2", "@x"]


def test_bytes(spark):
    raw = b"HTTP/1.1 200\r\nX: \xc3\xa9\r\n\r\n\x89PNG\r\n\r\n"
    assert bytes(one(spark, raw, X.image_bytes, "binary")) == b"\x89PNG\r\n\r\n"
    assert bytes(one(spark, b"GIF", X.image_bytes, "binary")) == b"GIF" and "�" in one(spark, b"a\xff", X.content_string, "binary")


def test_flatten(spark):
    df = spark.sql("select struct('a' as a, 'b' as b, struct('c' as x, 9 as y) as c) as s, 'd' as d, 5 as e, struct(null as f, 1 as g) as h")
    assert X.tab_delimit(df).first().value == "a\tb\tc\t9\td\t5\tnull\t1"
    assert X.flatten(df).columns == ["s_a", "s_b", "s_c_x", "s_c_y", "d", "e", "h_f", "h_g"]


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>a{b:c}</style><script>if (a<b) "</p>"</script></head>
<body><!-- <a href="no">no</a> --><p>One<b>two</b> three<p>four<br>five
<a href="http://a.org/x">first <i>link</i></a> <a name=n>none</a><a href='../rel'>rel</a> <A HREF=bare>bare</A> <a href="javascript:x()">js</a><a href="mailto:a@b.c">m
<img src="pic.png"><IMG alt="a>b" src='../logo.gif'><img><img src="foo:x"></body>"""


def test_links(spark):
    base = "http://b.org/d/page.html"
    assert [(x["dst"], x["anchor"]) for x in H.links_of(base, PAGE, base)] == [("http://a.org/x", "first link"), ("http://b.org/rel", "rel"), ("http://b.org/d/bare", "bare"), ("mailto:a@b.c", "m")]
    assert [x["dst"] for x in H.links_of(base, PAGE)] == ["http://a.org/x", "mailto:a@b.c"]
    assert H.links_of(None, PAGE, base) == [] and H.links_of(base, "", base) == [] and H.links_of(base, None) == []
    assert H.images_of(base, PAGE) == ["http://b.org/d/pic.png", "http://b.org/logo.gif", ""]
    got = spark.createDataFrame([(base, PAGE)], "u string, h string").select(H.extract_links("u", "h", "u").alias("l"), H.extract_image_links("u", "h").alias("i")).first()
    assert len(got.l) == 4 and got.l[0].anchor == "first link" and len(got.i) == 3


def test_text():
    assert H.text_of(PAGE).startswith("T & x Onetwo three four five first link none") and "if (a" not in H.text_of(PAGE)
    assert H.text_of("") == "" and H.text_of(None) is None and H.text_of("a <b") == "a <b"


def test_main_text(spark):
    long = "this is a long paragraph of plain prose with many words in it that no reader would take for a menu of links "
    html = f"<ul><li><a href=x>home</a><li><a href=y>about</a></ul><p>{long}</p><p>{long}</p><div><a href=z>next page</a></div>"
    assert H.main_text_of(html) == f"{long.strip()} {long.strip()}"
    assert H.main_text_of("<a href=x>home</a>") is None and one(spark, "", H.main_text) is None


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + bytes(4) + b"IHDR" + (40).to_bytes(4, "big") + (30).to_bytes(4, "big")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x14\x00\x28\x03" + bytes(9)
    cases = [(png, (40, 30)), (b"GIF89a\x05\x00\x07\x00", (5, 7)), (jpeg, (40, 20)), (b"BM" + bytes(16) + (9).to_bytes(4, "little") + (8).to_bytes(4, "little"), (9, 8)), (b"", (0, 0)), (None, (0, 0)), (b"\xff\xd8", (0, 0)), (png[:18], (0, 0))]
    assert [media.size_of(d) for d, _ in cases] == [s for _, s in cases]
    assert tuple(one(spark, png, media.image_size, "binary")) == (40, 30)


@pytest.mark.parametrize(
    "data, kind",
    [(b"", "N/A"), (None, "N/A"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF89a", "image/gif"), (b"%PDF-1.4", "application/pdf"), (b" <!DOCTYPE html><p>", "text/html"), (b"<?xml version='1.0'?><a/>", "application/xml"),
     (b"<?xml version='1.0'?><rss>", "application/rss+xml"), (b"hello", "text/plain"), (b"\x00\x01\x02", "application/octet-stream"), (b"CWS\x09", "application/x-shockwave-flash")],
)
def test_mime(spark, data, kind):
    assert one(spark, data, media.detect_mime, "binary") == kind


@pytest.mark.parametrize("text, code", [("The people of the town were free to speak with each other", "en"), ("Les gens de la ville sont dans la rue avec nous", "fr"), ("Die Leute in der Stadt sind nicht mit uns auf der Straße", "de"), ("Los hombres de la ciudad no están con nosotros en el campo", "es"), ("", ""), (None, ""), ("123 !", "")])
def test_language(spark, text, code):
    assert one(spark, text, lang.detect_language) == code


def test_trained_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars > 200")
    profiles = lang.train_profiles(docs)
    right = docs.select((lang.detect_language(F.col("text"), profiles) == F.col("lang")).cast("int").alias("x")).agg(F.avg("x")).first()[0]
    assert set(profiles) == {"en", "fr", "de", "es"} and right > 0.95


def test_entities(spark):
    tag = ner.rule_tagger(places=frozenset({"Teoma"}))
    assert ner.entities("We saw Teoma there. Dr. Jane Roe joined Acme Corp yesterday.", tag) == {"PERSON": ["Jane Roe"], "ORGANIZATION": ["Acme Corp"], "LOCATION": ["Teoma"]}
    assert ner.entities(None, tag) == {"PERSON": [], "ORGANIZATION": [], "LOCATION": []}
    rows = ner.extract_entities(spark.createDataFrame([("20080430", "http://www.a.org/x", "Mr. John Doe met Mr. John Doe in Paris.")], "date string, url string, content string"))
    got = sorted((r.domain, r.ner_type, r.entity) for r in ner.entity_rows(rows).collect())
    assert got == [("www.a.org", "LOCATION", "Paris"), ("www.a.org", "PERSON", "John Doe"), ("www.a.org", "PERSON", "John Doe")]
    lines = spark.createDataFrame([("20080430 http://a {PERSON=[A B, C], ORGANIZATION=[], LOCATION=[D]}",), ("x",)], "value string")
    assert sorted(tuple(r) for r in ner.split_lists(lines).collect()) == [("20080430", "loc", "D"), ("20080430", "pers", "A B"), ("20080430", "pers", "C")]


@pytest.mark.parametrize("piece", ['<a "', "<a '\"", "<b", "<!", "<a href='x", "<script", "<a b=\"c'>", "<style>x"])
def test_unclosed_tags_take_linear_time(piece):
    """A megabyte of them, with and without an end, in seconds; each tag alone took quadratic time before."""
    import time

    begin = time.perf_counter()
    for end in ("", ">", '">', "'>x</a>"):
        H.links_of("http://a/", piece * (250_000 // len(piece)) + end, "http://a/")
    assert time.perf_counter() - begin < 20


def test_scan_equals_patterns():
    """Against the tag pattern, tried at every place, on random strings of markup."""
    import random
    import re

    tag = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
    rnd = random.Random(3)
    parts = ["<", ">", '"', "'", "a", " ", "/", "!", "--", "<a ", "</a>", "<!--", "-->", "<script>", "</script>", "<style", "x=", "<b>", "é"]
    for _ in range(4000):
        html = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 25)))
        if re.search(r"<[a-z]+[\"']", html, re.I):
            continue  # quotes within names
        at, want = 0, []
        for m in tag.finditer(html):
            want.append(((m[3] or m[1] or "!").lower(), m[2] == "/", m[4] or "", html[at : m.start()]))
            at = m.end()
        assert list(H.scan(html)) == [*want, ("", False, "", html[at:])], html


def test_languages_of_many_texts_at_once():
    """As text by text: any script, ties, digits, capitals without a lower case, more texts than a slice takes."""
    rnd = random.Random(3)
    letters = "abcdeéßñσΣςİı中文字漢ѡж𝔄ª²½_ 019-'\n\t \u0301"
    texts = [None, "", "123 _", "²", *lang.SAMPLES.values()] + ["".join(rnd.choices(letters, k=rnd.randrange(120))) for _ in range(1200)]
    texts += ["".join(chr(rnd.randrange(0x61, 0x3000)) for _ in range(3000)), "x" * 2_000_000]
    profiles = {"b": lang.ranked("abc dé"), "a": lang.ranked("abc dé"), "z": lang.ranked("中文 жж")}
    for p in (None, profiles):
        assert lang.detect_all(texts, p) == [lang.detect(t, p) for t in texts]
