"""Rules, policies and ablations against brute force, and awkward rows."""

import random
import re
import unicodedata
from collections import Counter

import duckdb
import pytest

from crawlspan.llm import queries, rules

TEXTS = [None, "", "   \n", "one", "Plain words that make an ordinary sentence of prose.", "A!! B!! C!! D!! E!!", "&&& $$$ ### word*** more%%%", "SHOUTING ALL THE WAY THROUGH THIS WHOLE LINE OF TEXT",
         "the the the the the the the the the the the the the the the the the the the the the", "line\nline\nline\nline\nother", "a | b | c | d | e | f | g | h | i | j | k", "ÉTÉ été ÄÖ", "x" * 200_000, "w " * 60_000]


def brute(t):
    t = t or ""
    ws, ls = [w for w in re.split(r"[ \t\n\r]+", t) if w], t.split("\n")
    n = max(len(ws), 1)
    c = max(len(t), 1)
    return (len(t), len(ws), sum(t.count(x) for x in "#$%&*") / c, sum(unicodedata.category(x) == "Lu" for x in t) / c, t.count("!") / n, len(set(ws)) / n,
            sum(a == b for a, b in zip(ws, ws[1:])) / n, (len(ls) - len(set(ls))) / len(ls), t.count("|") / n, sum(map(len, ws)) / n)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "again again", "y"), (4, TEXTS[4], "z")], "doc_id long, text string, n_words string")


def test_measures(docs):
    for r in rules.ledger(docs).filter("doc_id is not null").collect():
        assert tuple(r[m] for m in rules.MEASURES) == pytest.approx(brute(TEXTS[r.doc_id]))


def test_policies_and_ablations(docs):
    rows = rules.apply_policies(rules.ledger(docs)).collect()
    assert len(rows) == docs.count()
    got = {(r.policy, r.rule): r for r in rules.ablations(rules.ledger(docs)).collect()}
    for v, m in rules.POLICIES.items():
        assert all(r[f"pass_{v}"] == (r.fail_bits & m == 0) for r in rows)
        for x in rules.RULES:
            if m >> x.bit & 1:
                b = 1 << x.bit
                seen = [r.fail_bits & m for r in rows]
                assert (got[v, x.name].failed, got[v, x.name].failed_alone, got[v, x.name].passed, got[v, x.name].passed_without) == (
                    sum(s & b > 0 for s in seen), sum(s == b for s in seen), sum(s == 0 for s in seen), sum(s & ~b == 0 for s in seen))


def test_what_passes(docs):
    kept = rules.accept(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter([TEXTS[3], TEXTS[4], TEXTS[4], TEXTS[11], TEXTS[12], "again again"])
    assert rules.accept(docs.limit(0)).count() == 0
    assert {r.failed for r in rules.ablations(rules.ledger(docs.limit(0))).collect()} == {0}


def test_clean_labels_pass(spark):
    sf = "/root/testdata/sf0.01"
    rows = rules.apply_policies(rules.ledger(spark.read.parquet(f"{sf}/documents.parquet"))).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.pass_v2 for r in good) >= 0.99 * len(good)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    rel = c.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(r[rel.columns.index(x)] for x in columns) for r in rel.fetchall()), key=repr)


def judged(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in rules.apply_policies(rules.apply_policies(rules.later_ledger(df)), rules.LATER_POLICIES).collect()}


def prose(n):
    """n words whose frequencies fall as in prose, without a long repeat."""
    rnd = random.Random(n)
    return rnd.choices([f"w{i}" for i in range(60_000)], [1 / (i + 12) for i in range(60_000)], k=n)


def test_variety_does_not_fall_with_length(spark):
    words = prose(100_000)
    again = [w + str(k) for k in range(40) for w in prose(100) * 5]
    got = judged(spark, [" ".join(words), " ".join(prose(400) * 250), " ".join(prose(400) * 10), " ".join(again), " ".join(prose(40) * 3), "", None])
    assert not got[0].pass_v2 and got[0].pass_v3
    assert got[0].window_ratio == pytest.approx(sum(len(set(words[i : i + rules.WINDOW])) for i in range(0, len(words), rules.WINDOW)) / len(words))
    assert not any(got[i].pass_v3 for i in (1, 2, 3, 4, 5, 6)) and all(got[i].fail_bits >> 11 & 1 for i in (1, 2, 3, 4))
    assert rules.accept(spark.createDataFrame([(" ".join(words),)], "text string").selectExpr("1 AS doc_id", "text")).count() == 1


def test_blank_lines_are_no_repeats(spark):
    paragraphs = [" ".join(prose(30 + i)) for i in range(40)]
    got = judged(spark, ["\n\n".join(paragraphs), "\r\n \t\r\n".join(paragraphs), "\n\n".join(paragraphs[:4] * 5), "\n\n", "\n\n".join(["same line"] * 3 + ["other"])])
    assert [got[i].pass_v4 for i in range(5)] == [True, True, False, False, False] and not got[0].pass_v2 and not got[0].pass_v3
    assert [got[i].full_line_dup_ratio for i in range(5)] == pytest.approx([0, 0, 0.8, 0, 0.5])
    assert rules.accept(spark.createDataFrame([(1, "\n\n".join(paragraphs))], "doc_id long, text string")).count() == 1


def test_later_ledger_on_awkward_rows(spark, docs):
    c = duckdb.connect()
    data = docs.select("doc_id", "text").toArrow()
    c.register("documents", data)
    rel = c.sql(f"WITH {rules.later_ledger_sql()} SELECT * FROM z")
    got = rules.later_ledger(docs)
    assert sorted(rel.columns) == sorted(got.columns)
    key = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted((tuple(r[x] for x in rel.columns) for r in got.collect()), key=key), sorted(rel.fetchall(), key=key), strict=True):
        assert a == pytest.approx(b)
