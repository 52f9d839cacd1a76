"""Segmentation and naive Bayes against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

from crawlspan.llm import url_filter as U

TEXT = "cheap flights and pills for a free casino win the river of stone garden path " * 3


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(1)
    good = ["rivergarden", "stonepath", "thegardenpath", "gardenstone"]
    bad = ["cheappills", "freecasinowin", "casinopills"]
    rows = []
    for i in range(120):
        host = rnd.choice(bad if i % 4 == 0 else good)
        rows.append((i, f"https://www.{host}{i % 7}.example.com/{rnd.choice(['en', 'stone/river', 'win'])}?x={i}", f"<p>{TEXT}</p><script>grubzal</script>", 1))
    return spark.createDataFrame(rows, "page_id long, url string, html string, words int")


def brute(run, counts):
    total = sum(counts.values())
    best = None
    for k in range(len(run)):
        for cuts in itertools.combinations(range(1, len(run)), k):
            parts = [run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))]
            p = sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in parts)
            if best is None or p > best[0] + 1e-9 or (abs(p - best[0]) <= 1e-9 and len(parts[-1]) > len(best[1][-1])):
                best = (p, parts)
    return best


def likelihood(parts, counts):
    total = sum(counts.values())
    return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in parts)


def test_viterbi(pages, spark):
    counts = {r.word: r.n for r in U.unigrams(pages).collect()}
    assert counts["pills"] == 3 * 120 and "grubzal" not in counts
    asked = ["cheappills", "freewin", "stone", "qzx", "a", "casinoxwin", "riverofsto", "éténé", "xstonex"]
    words = {r.run: r.words for r in U.segmented(spark.createDataFrame([(a,) for a in [*asked, "q" * 3000 + "stone"]], "run string"), U.unigrams(pages)).collect()}
    for a in asked:
        p, parts = brute(a, counts)
        assert "".join(words[a]) == a and likelihood(words[a], counts) == pytest.approx(p) and len(words[a][-1]) == len(parts[-1])
    assert words["stone"] == ["stone"] and words["q" * 3000 + "stone"] == ["q" * 3000, "stone"]


def test_splits_of_many_runs_at_once():
    rnd = random.Random(3)
    vocab = {"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5))): rnd.randrange(1, 60) for _ in range(14)}
    total = sum(vocab.values())
    asked = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(150)]
    hits = [(i, s, len(w), n) for i, r in enumerate(asked) for w, n in vocab.items() for s in range(len(r)) if r.startswith(w, s)]
    row, start, length, n = (U.np.array(c) for c in zip(*hits))
    for r, cuts in zip(asked, U.best_splits(U.np.array([len(r) for r in asked]), row, start, length, n.astype(float), total)):
        got = [r[a:b] for a, b in zip(cuts, [*cuts[1:], len(r)])]
        p, parts = brute(r, vocab)
        assert "".join(got) == r and likelihood(got, vocab) == pytest.approx(p) and len(got[-1]) == len(parts[-1])


def test_bayes(spark, pages):
    rows = [(r.url, int(bool(re.search("pills|casino", r.url)))) for r in pages.collect()]
    labels = spark.createDataFrame(rows, "url string, blocked int")
    out = U.score(pages, labels).collect()
    words = {r.url: r.words for r in out}
    n, tokens = Counter(y for _, y in rows), {0: Counter(), 1: Counter()}
    for u, y in rows:
        tokens[y].update(words[u])
    vocab = len(set(tokens[0]) | set(tokens[1]))
    weight = lambda w: math.log((tokens[1][w] + 1) / (sum(tokens[1].values()) + vocab)) - math.log((tokens[0][w] + 1) / (sum(tokens[0].values()) + vocab))
    assert len(out) == 120
    for r in out:
        assert r.score == pytest.approx(math.log(n[1] / n[0]) + sum(map(weight, words[r.url])))
        assert r.blocked == bool(re.search("pills|casino", r.url))
        assert all(w[:2] in ("h:", "p:") for w in r.words) and ("p:win" in r.words) == ("/win?" in r.url)


def test_held_out_names(spark):
    """Names that the labelled addresses lack, their words joined otherwise and without hyphens."""
    bad = ["cheapviagraonline", "freecasinobonus", "adulthotchat", "winbets", "adsbannerclick", "pokerwin", "linkspam", "slotsbonusfree", "payday-loans", "sexchat"]
    good = ["citymuseum", "dailyweathernews", "historylibrary", "mountainbikeclub", "familygarden", "musicschool", "photogallery", "travelrecipes", "universityjournal", "towncouncilnews", "gartenhaus", "thther"]
    pages = spark.createDataFrame([(i, f"https://www.{h}.example.org/en/{i}?page=2", "<p>some visible text</p>") for i, h in enumerate(bad + good)], "page_id long, url string, html string")
    assert not {f"http://{h}/" for h in bad + good} & {u for u, _ in U.ADDRESSES}
    found = {r.page_id for r in U.score(pages).collect() if r.blocked}
    assert len(found & set(range(len(bad)))) >= 9 and len(found - set(range(len(bad)))) <= 1


def test_labels_and_awkward_rows(spark, pages):
    extra = spark.createDataFrame([(7, None, None, 1), (7, None, None, 1), (None, "http://12.34/", "", 1), (8, "", "<p>", 1), (9, "HTTP://CheapPills.Example/Ü", "x", 1)], "page_id long, url string, html string, words int")
    both = pages.union(extra)
    labels = both.selectExpr("url", "int(url like '%river%') as blocked")
    out = U.score(both, labels).collect()
    assert len(out) == 125
    assert [(r.words, r.score, r.blocked) for r in out if r.url is None] == [(None, None, False)] * 2
    assert {r.words is not None and len(r.words) for r in out if r.url in ("", "http://12.34/")} == {0}
    assert next(r for r in out if r.page_id == 9).words == ["h:cheap", "h:pills", "h:example", "p:ü"]
    assert not any(r.blocked for r in U.score(both, labels.filter("blocked = 0")).collect())
    assert U.score(both.limit(0)).count() == 0


def test_scripts_and_escapes(spark):
    pages = spark.createDataFrame([(1, "http://éclat.example/%C3%A9t%C3%A9/na%C3%AFve?q=%zz", "<p>été naïve éclat</p>")], "page_id long, url string, html string")
    assert U.score(pages).first().words[:2] == ["h:éclat", "h:example"]
    pages = spark.createDataFrame([(1, "http://éclat.example/%C3%A9t%C3%A9/na%C3%AFve", "<p>été naïve éclat</p>")], "page_id long, url string, html string")
    assert U.score(pages).first().words == ["h:éclat", "h:example", "p:été", "p:naïve"]
