"""Functions from SQL."""

from crawlspan.functions.register import register


def test_sql(spark):
    register(spark)
    row = spark.sql("SELECT web_host('http://www.a.org:80/x') h, without_www('www.a.org') w, reverse_host('a.b.c:80') r, hashtags('x #y') t, remove_html('<p>a<p>b') p, detect_language('the people of the town') l").first()
    assert tuple(row) == ("www.a.org", "a.org", "c.b.a:80", ["#y"], "a b", "en")
    assert spark.sql("SELECT web_host('index.html') a, web_host('mailto:x') b").first() == (None, "")
    rows = spark.sql("SELECT p.id, l.* FROM (SELECT 1 AS id, 'http://a.org/' AS u, '<a href=/x>y</a>' AS h) p, LATERAL links(p.u, p.h) l").collect()
    assert [tuple(r) for r in rows] == [(1, "http://a.org/", "http://a.org/x", "y")]
    assert spark.sql("SELECT extract_links('http://a/', '<a href=b>c</a>', 'http://a/') x").first().x[0].dst == "http://a/b"
    assert spark.sql("SELECT entities('Mr. John Doe left') e").first().e["PERSON"] == ["John Doe"]
