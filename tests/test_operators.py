"""Filters, graphs, dictionary, store, index, images, sinks and streams on small tables."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from crawlspan.functions.text import DateComponent
from crawlspan.operators import aggregate as A
from crawlspan.operators import dictionary as D
from crawlspan.operators import filters as K
from crawlspan.operators import graph as G
from crawlspan.operators import index as I
from crawlspan.operators import store as S
from crawlspan.operators.images import popular_images
from crawlspan.sources import archive, codec, sinks
from crawlspan.streaming import crawl

ROWS = [
    ("20080430", "http://www.a.org/", "text/html", "<a href='/x'>x</a>the people and the river"),
    ("20080501", "http://a.org/b.htm", None, "body"),
    ("20080501", "https://b.org/robots.txt", "text/html", "no"),
    (None, "http://c.org/page.html", "text/html", "undated"),
    ("20080502", "http://c.org/pic.jpg", None, None),
    ("20080502", None, "image/gif", "gif"),
    ("20080502", "index", "text/plain", "tekst"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, "crawl_date string, url string, mime_type string, content string")


def urls(df):
    return sorted(str(r.url) for r in df.collect())


def test_pages_and_images(records):
    assert urls(K.keep_valid_pages(records)) == ["http://a.org/b.htm", "http://www.a.org/"]
    assert urls(K.keep_images(records)) == ["None", "http://c.org/pic.jpg"]


PAIRS = [
    ("mime_types", ["text/html"], 3),
    ("mime_types", ["text/html", None], 5),
    ("urls", ["http://a.org/b.htm", "zz"], 1),
    ("urls", [None], 1),
    ("url_patterns", ["http://(www.)?a.org/.*"], 2),
    ("domains", ["c.org", "a.org"], 3),
    ("content", ["river", "^g"], 2),
    ("languages", ["en"], None),
]


@pytest.mark.parametrize("name, values, n", PAIRS)
def test_keep_and_discard_part_the_rows(records, name, values, n):
    keep, drop = getattr(K, f"keep_{name}")(records, values), getattr(K, f"discard_{name}")(records, values)
    assert sorted(map(str, keep.collect() + drop.collect())) == sorted(map(str, records.collect()))
    assert n is None or keep.count() == n


def test_long_lists_are_joined(records):
    many = [f"http://x/{i}" for i in range(K.MANY + 5)] + ["http://a.org/b.htm", None]
    assert K.keep_urls(records, many).count() == 2 and K.discard_urls(records, many).count() == 5
    assert K.keep_urls(records, many[:-1]).count() == 1 and K.discard_urls(records, many[:-1]).count() == 6


def test_dates(records):
    assert K.keep_date(records, "200805", DateComponent.YYYYMM).count() == 5 and K.keep_date(records, None).count() == 1
    assert K.discard_date(records, None).count() == 6 and K.discard_date(records, "20080501").count() == 5
    assert K.keep_date_range(records, "20080501", "20080501").count() == 2 and K.keep_date_range(records).count() == 7
    assert K.keep_domains(records, ["a.org"], strip_www=True).count() == 2 and K.keep_http(records).count() == 4


def test_count_items(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "x string")
    assert [tuple(r) for r in A.count_items(df).collect()] == [("b", 2), (None, 1), ("a", 1)]


def test_pivot(spark):
    df = spark.createDataFrame([("01", "a", 5), ("01", "b", 1), ("02", "b", 9), ("02", "c", 1)], "d string, s string, n long")
    assert {r.d: (r.b, r.a, r.other) for r in A.pivot_top(df, "d", "s", "n", 2).collect()} == {"01": (1, 5, 0), "02": (9, 0, 1)}


@pytest.fixture(scope="module")
def ids(spark):
    return D.url_ids(spark.createDataFrame([(w,) for w in ("dogs", "cat", "catch", "cut", "doga", "dogb", "cat", None)], "url string").repartition(4))


def test_dictionary(spark, ids):
    assert {r.url: r.id for r in ids.collect()} == {"cat": 0, "catch": 1, "cut": 2, "doga": 3, "dogb": 4, "dogs": 5}
    assert [r.url for r in D.prefix_search(ids, "dog").collect()] == ["doga", "dogb", "dogs"]
    assert D.prefix_search(ids, "").count() == D.prefix_search(ids, None).count() == 0
    assert D.id_range(ids, "cat", "doga") == (0, 3) and D.id_range(ids, "cat", "no") is None
    asked = spark.createDataFrame([("cut",), ("no",)], "url string")
    assert {r.url: r.id for r in D.lookup(asked, ids).collect()} == {"cut": 2, "no": -1}
    assert {r.id: r.url for r in D.reverse_lookup(spark.createDataFrame([(5,), (9,)], "id long"), ids).collect()} == {5: "dogs", 9: None}
    prefixes = spark.createDataFrame([(1, "c"), (2, "cat"), (3, "dog"), (4, "x"), (5, "")], "prefix_id int, prefix string")
    assert {r.prefix_id: (r.start_id, r.end_id) for r in D.prefix_intervals(ids, prefixes).collect()} == {1: (0, 2), 2: (0, 1), 3: (3, 5)}
    assert {r.url: r.site for r in D.site_of(ids, prefixes, "url", "site").collect()} == {"cat": 2, "catch": 2, "cut": 1, "doga": 3, "dogb": 3, "dogs": 3}
    assert D.url_ids(asked.limit(0)).count() == 0


def test_no_nested_loop(ids, spark):
    prefixes = spark.createDataFrame([(1, "c")], "prefix_id int, prefix string")
    assert "NestedLoop" not in D.prefix_intervals(ids, prefixes)._jdf.queryExecution().toString()


EDGES = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "c")]


def brute_rank(edges, rounds):
    nodes = sorted({x for e in edges for x in e})
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    rank = dict.fromkeys(nodes, 0.15)
    for _ in range(rounds):
        rank = {n: 0.15 + 0.85 * sum(rank[m] * out[m].count(n) / len(out[m]) for m in nodes if out[m]) for n in nodes}
    return rank


def test_pagerank(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    got = {r.node: r.page_rank for r in G.pagerank(edges, 12).collect()}
    assert got == pytest.approx(brute_rank(EDGES, 12))
    settled = {r.node: r.page_rank for r in G.pagerank(edges, tolerance=1e-4).collect()}
    assert settled == pytest.approx(brute_rank(EDGES, 200), abs=1e-2)
    assert {(r.node, r.in_degree, r.out_degree) for r in G.degrees(edges).collect()} == {("a", 1, 3), ("b", 2, 1), ("c", 3, 1), ("d", 0, 1)}
    assert G.pagerank(edges.limit(0), 3).count() == 0


def page(url, *targets, date="20080430"):
    return (date, url, "text/html", "".join(f"<a href='{t}'>to {t}</a>" for t in targets))


@pytest.fixture(scope="module")
def web(spark):
    rows = [page("http://www.a.org/", "http://b.org/x", "http://b.org/x", "/in"), page("http://b.org/x", "http://www.a.org/", "mailto:q@b.org"), page("http://c.org/", date="20080501"), page("http://a.org/in", "http://c.org/")]
    return spark.createDataFrame(rows, "crawl_date string, url string, mime_type string, content string")


def test_graphs(web, spark, tmp_path):
    vertices, edges = G.extract_graph(web, iterations=3)
    counts = {(r.src, r.dst): r["count"] for r in G.edge_counts(edges).collect()}
    assert counts == {("a.org", "b.org"): 2, ("a.org", "a.org"): 1, ("b.org", "a.org"): 1, ("a.org", "c.org"): 1}
    assert {r.domain: (r.in_degree, r.out_degree) for r in vertices.collect()} == {"a.org": (2, 4), "b.org": (2, 1), "c.org": (1, 0)}
    ids = D.url_ids(web)
    name = {r.id: r.url for r in ids.collect()}
    graph = {name[r.src_id]: [name[int(x)] for x in r.dst_ids.split(",") if x] for r in G.page_graph(web, ids).collect()}
    assert graph == {"http://www.a.org/": ["http://b.org/x"], "http://b.org/x": ["http://www.a.org/"], "http://c.org/": [], "http://a.org/in": ["http://c.org/"]}
    assert [r.anchor for r in G.anchor_text(web, ids).filter(F.col("dst_id") == ids.filter("url = 'http://b.org/x'").first().id).collect()] == ["to http://b.org/x"] * 2
    prefixes = spark.createDataFrame([(1, "http://www.a.org"), (2, "http://b.org"), (3, "http://b.org/x")], "prefix_id int, prefix string")
    assert [tuple(r) for r in G.site_graph(web, prefixes).collect()] == [(1, 1, 1), (1, 3, 2), (3, 1, 1)]
    assert G.site_graph(web, prefixes, begin="20090101").count() == 0
    sinks.write_graph(vertices, edges, f"{tmp_path}/v", f"{tmp_path}/e")
    lines = [json.loads(x) for f in glob.glob(f"{tmp_path}/v/*.json") for x in open(f)]
    assert {x["domain"]: x["inDegree"] for x in lines} == {"a.org": 2, "b.org": 2, "c.org": 1}
    sinks.write_gdf(G.edge_counts(edges), f"{tmp_path}/g.gdf")
    text = open(f"{tmp_path}/g.gdf").read().splitlines()
    assert text[0].startswith("nodedef>") and text[1:4] == ["a.org", "b.org", "c.org"] and text[4].startswith("edgedef>") and "a.org,b.org,2,20080430" in text
    assert sinks.write_gdf(G.edge_counts(edges), "") is None


def test_other_sinks(spark, tmp_path):
    assert sinks.write_json_array(spark.range(3), f"{tmp_path}/a.json") == 3 and json.load(open(f"{tmp_path}/a.json")) == [{"id": 0}, {"id": 1}, {"id": 2}]
    sinks.by_month(spark.createDataFrame([("20080430 x",), ("20080501 y",)], "value string"), F.col("value"), f"{tmp_path}/m")
    assert {p.rsplit("=")[-1] for p in glob.glob(f"{tmp_path}/m/month=*")} == {"200804", "200805"}
    sinks.entity_lists(spark.createDataFrame([("20080430 {PERSON=[A], ORGANIZATION=[], LOCATION=[B, C]}",)], "value string"), f"{tmp_path}/e", dated=True)
    assert len(glob.glob(f"{tmp_path}/e/date=20080430/kind=*")) == 2
    (tmp_path / "x.tsv").write_text("20080430\ta\tb\t3\n")
    sinks.tsv_to_gdf(spark, f"{tmp_path}/x.tsv", f"{tmp_path}/x.gdf")
    assert "a,b,3,20080430" in open(f"{tmp_path}/x.gdf").read()
    sinks.save_text(spark.sql("select 1 as a, struct('b' as c) as d"), f"{tmp_path}/t")
    assert [open(f).read() for f in glob.glob(f"{tmp_path}/t/part*")] == ["1\tb\n"]


def crawl_file(path):
    R = lambda url, mime, content, date="20080430204825": codec.Record("ARC", None, url, "1.2.3.4", date, mime, len(content), content)
    codec.write(path, [R("filedesc://x", "text/plain", b"1"), R("dns:a.org", "text/dns", b"x"), R("http://a.org/", "text/html", b"one"), R("http://a.org/", "text/html", b"two", "20080501000000"), R("bad", "text/plain", b"x"), R("http://a.org/big", None, b"x" * 200)])


def test_store(spark, tmp_path):
    crawl_file(f"{tmp_path}/in.arc.gz")
    raw = archive.read(spark, f"{tmp_path}/in.arc.gz")
    store = S.Store(spark, f"{tmp_path}/store")
    assert store.collections().count() == 0
    store.create("c")
    with pytest.raises(ValueError):
        store.create("c")
    assert store.ingest(raw, "c", max_bytes=100) == {"seen": 6, "too_large": 1, "invalid": 3, "taken": 2}
    store.ingest(raw, "c", max_bytes=100)
    captures = store.captures("c")
    assert captures.count() == 2 and store.content("c", "http://a.org/", "20080430204825") == b"one" and store.content("c", "http://a.org/", "20080430204826") is None
    assert [str(r.ts) for r in S.history(captures, "http://a.org/").collect()] == ["2008-04-30 20:48:25", "2008-05-01 00:00:00"]
    wanted = spark.sql("select 'org.a/' as url_key, timestamp'2008-04-30 23:59:00' as at")
    assert str(S.closest(captures, wanted).first().ts) == "2008-05-01 00:00:00"
    q = S.capture_query(captures, "http://a.org/", at="20080430000000").collect()
    assert [(r.n, r.is_closest) for r in q] == [(1, True), (2, False)]
    assert S.capture_query(captures, "http://a.org/", begin="20080501").count() == 1 and S.capture_query(captures, "http://a.org/", end="20080430").count() == 1
    assert [r.n for r in S.capture_query(captures, "http://a.org/", page=2, size=1).collect()] == [2]
    store.create("c", force=True)
    assert store.captures("c").count() == 0
    store.drop("c")
    assert store.collections().count() == 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    crawl_file(f"{tmp_path}/in/one.arc.gz")
    crawl_file(f"{tmp_path}/in/two.arc.gz")
    raw = crawl.stream_archives(spark, f"{tmp_path}/in")
    q = crawl.first_captures(raw.filter("url like 'http%'")).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("firsts").count() == 3
    store = S.Store(spark, f"{tmp_path}/store")
    store.create("s")
    crawl.ingest(raw, store, "s", f"{tmp_path}/check").awaitTermination(120)
    assert store.captures("s").count() == 3
    days = crawl.pages_by_day(raw.filter("url = 'http://a.org/'")).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    days.awaitTermination(120)
    assert sorted(r.n for r in spark.table("days").collect()) == [2, 2]


def test_index(spark):
    docs = spark.createDataFrame([(1, "The River and the stone"), (2, "river RIVER bank"), (3, None)], "id long, text string")
    index = I.inverted_index(docs, "id", "text", shards=3)
    assert {r.block for r in index.collect()} == {0}
    assert {r.term: (r.df, [(p.key, p.tf) for p in r.postings]) for r in index.collect()} == {"river": (2, [(1, 1), (2, 2)]), "stone": (1, [(1, 1)]), "bank": (1, [(2, 1)])}
    assert [tuple(r) for r in I.search(index, "River").collect()] == [(2, 2), (1, 1)] and [r.key for r in I.search(index, "river", "bank").collect()] == [2]
    x = spark.createDataFrame([("abc",)], "t string").select(I.ngrams("t", 2, 3).alias("g"), I.shingles(F.split(F.lit("a b c d e"), " "), 4, 5).alias("s")).first()
    assert x.g == ["ab", "bc", "abc"] and x.s == ["a b c d", "b c d e", "a b c d e"]
    rows = spark.createDataFrame([("http://a/", "text/html", "x"), ("ftp://a/", "text/html", "x"), ("http://b/", "image/png", "x"), ("http://c/", None, "x")], "url string, mime_type string, content string")
    assert urls(I.indexable(rows)) == ["http://a/", "http://c/"]


def test_index_in_blocks(spark, tmp_path):
    docs = spark.range(300).selectExpr("id", "concat('common', if(id % 7 = 0, ' rare', '')) as text")
    one = {r.key: r.score for r in I.search(I.inverted_index(docs, "id", "text"), "common", "rare").collect()}
    split = I.inverted_index(docs, "id", "text", block=20)
    sizes = [len(r.postings) for r in split.filter("term = 'common'").collect()]
    assert len(sizes) > 8 and sum(sizes) == 300 and {r.df for r in split.filter("term = 'common'").collect()} == {300}
    assert {r.key: r.score for r in I.search(split, "common", "rare").collect()} == one
    counts = I.write_index(docs, "id", "text", f"{tmp_path}/index", shards=3, block=20)
    assert counts["postings"] == 300 + 43 and len(glob.glob(f"{tmp_path}/index/shard=*")) <= 3
    assert {r.key: r.score for r in I.search(I.read_index(spark, f"{tmp_path}/index"), "common", "rare").collect()} == one
    assert I.inverted_index(docs.limit(0), "id", "text").count() == 0


def test_ingest_resumes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        crawl_file(f"{tmp_path}/in/{k}.arc.gz")
    (tmp_path / "in" / "1.arc.gz").write_bytes(b"no records")
    store = S.Store(spark, f"{tmp_path}/store")
    store.create("c")
    got = store.ingest_files(f"{tmp_path}/in", "c", step=1)
    assert got == {"seen": 12, "too_large": 0, "invalid": 6, "taken": 6, "next": 3}
    assert store.ingest_files(f"{tmp_path}/in", "c", start=2)["seen"] == 6 and store.ingest_files(f"{tmp_path}/in", "c", start=9)["next"] == 9
    before = sorted(map(str, store.captures("c").collect()))
    old = store.dump().count()
    store.compact("c", "gzip")
    assert sorted(map(str, store.captures("c").collect())) == before and store.dump().count() == old + 1
    assert store.collections().count() == 1


def test_written_archives_come_back(spark, tmp_path):
    rows = spark.sql("select timestamp'2008-04-30 20:48:25' as crawl_ts, 'http://a.org/x,y' as url, 'text/html' as mime_type, cast('body' as binary) as content union all select null, 'http://b.org/', null, cast('' as binary)")
    archive.write(rows, f"{tmp_path}/a,b", "arc")
    got = {r.url: r for r in archive.load_arc(spark, [f"{tmp_path}/a,b"]).collect()}
    assert got["http://a.org/x,y"].crawl_date == "20080430" and got["http://b.org/"].crawl_date is None and got["http://b.org/"].mime_type == "no-type"
    archive.write(rows, f"{tmp_path}/a,b", "warc")
    assert {r.format for r in archive.read(spark, f"{tmp_path}/a,b").collect()} == {"WARC"}


def test_entities_json(spark, tmp_path):
    triples = spark.createDataFrame([("20080430", "http://a.org/", "Mr. John Smith met John Smith in Toronto."), ("20080430", "http://b.org/", None)], "date string, url string, content string")
    n = sinks.write_entities_json(triples, f"{tmp_path}/e.json")
    rows = json.load(open(f"{tmp_path}/e.json"))
    assert n == len(rows) and all(set(r) == {"date", "domain", "ner"} for r in rows)


def test_popular_images(spark):
    png = lambda w, h, t=b"": b"\x89PNG\r\n\x1a\n" + bytes(4) + b"IHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + t
    rows = [("20080430", f"http://a/{i}.png", "image/png", b) for i, b in enumerate([png(40, 40), png(40, 40), png(40, 40, b"x"), png(5, 40), b"junk", png(31, 30)])]
    df = spark.createDataFrame(rows, "crawl_date string, url string, mime_type string, image_bytes binary")
    assert [tuple(r) for r in popular_images(df, 2).collect()] == [("http://a/0.png", 2), ("http://a/2.png", 1)]


def test_entity_nesting(spark):
    rows = [("20080430", "a.org", "PERSON", "X"), ("20080430", "a.org", "PERSON", "X"), ("20080430", "a.org", "LOCATION", "Y")]
    df = A.combine_entities(spark.createDataFrame(rows, "date string, domain string, ner_type string, entity string"))
    assert df.count() == 1
    assert sorted((r.ner_type, r.entity, r.freq) for r in A.explode_entities(df).collect()) == [("LOCATION", "Y", 1), ("PERSON", "X", 2)]


def test_entity_lists_of_many_lines(spark, tmp_path, monkeypatch):
    """An entity that all lines name doesn't come to one file; all rows are there."""
    monkeypatch.setattr(sinks, "LINES", 50)
    lines = spark.range(2000).selectExpr("concat('20080430 {PERSON=[q, p', id, '], ORGANIZATION=[], LOCATION=[]}') as value")
    sinks.entity_lists(lines, f"{tmp_path}/e")
    found = [open(f).read().split() for f in glob.glob(f"{tmp_path}/e/kind=pers/part*")]
    assert sorted(x for f in found for x in f) == sorted(["q"] * 2000 + [f"p{k}" for k in range(2000)])
    assert max(len(f) for f in found) < 1000


def test_index_of_repeated_keys(spark, monkeypatch):
    """Rows that share a key, NULL too, count as one document; runs of few documents and blocks of few postings give the same counts."""
    texts = ["One one two", "two THREE É²", "the one", "ein Straße", "x1 x1", None, "", "Ωs ΑΣ"]
    docs = spark.createDataFrame([(k if k % 5 else None, texts[k % 8] + " common" if texts[k % 8] else None) for k in list(range(40)) + [3, 3, 17]], "id long, text string")
    want = {(r.term, r.id): r.tf for r in I.term_counts(docs, "id", "text").collect()}
    monkeypatch.setattr(I, "_HELD", 1)
    for block in (4, 1000):
        rows = I.inverted_index(docs, "id", "text", block=block).collect()
        assert {(r.term, p.key): p.tf for r in rows for p in r.postings} == want and sum(len(r.postings) for r in rows) == len(want)
        assert all(r.df == sum(t == r.term for t, _ in want) for r in rows) and all(r.postings == sorted(r.postings, key=lambda p: (p.key is not None, p.key or 0)) for r in rows)
