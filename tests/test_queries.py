"""Every registered query of the reference's operators against DuckDB over the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from crawlspan.functions.html import text_of
from crawlspan.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


#: Queries that SQL can't express, each with a test of its own below.
WITHOUT_SQL = {"main_text", "page_entities"}


def test_all_but_these_have_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == WITHOUT_SQL


def test_main_text(spark):
    """Made of blocks of the visible text, in order, with the paragraphs that are long and hold no link."""
    text = {r.page_id: r.text for r in registry.QUERIES["page_text"](spark, SF).collect()}
    rows = registry.QUERIES["main_text"](spark, SF).collect()
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(text) and sum(r.text is not None for r in rows) > 0.9 * len(rows)
    for r in rows:
        squeezed = " ".join(r.text.split()) if r.text else ""
        assert len(squeezed) <= len(text[r.page_id])
        for block in re.findall(r"<p>([^<&]{200,})</p>", html[r.page_id]):
            assert " ".join(block.split()) in squeezed


def test_page_entities(spark):
    """Every mention stands in the text of a page of its date and domain, in one of the kinds."""
    pages = {}
    for r in spark.sql("select 1").sparkSession.read.parquet(f"{SF}/pages.parquet").collect():
        pages.setdefault(re.match(r"https?://([^/:?#]*)", r.url)[1], []).append(text_of(r.html))
    rows = registry.QUERIES["page_entities"](spark, SF).collect()
    assert {r.ner_type for r in rows} <= {"PERSON", "LOCATION", "ORGANIZATION"}
    for r in rows:
        assert any(" ".join(r.entity.split()[:1]) in t for t in pages[r.domain])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_page_graph_of_repeated_urls(spark, tmp_path):
    """A URL captured in a day within the dates and, with other links, as no HTML and on a day outside."""
    page = lambda i, u, to: (i, f"http://{u}", f'<html><body><a href="/{to}">x</a></body></html>')
    rows = [page(4, "a.org/", "one"), page(3, "a.org/", "two"), page(60, "a.org/", "three"), page(5, "b.org/", "four"), page(12, "c.org/", "five"), page(13, "c.org/", "five")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, registry.QUERIES["page_graph"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert got == sorted(c.sql(registry.ORACLES["page_graph"]).fetchall())
    assert max(len(d.split(",")) for _, d in got) == 3
