"""Code lengths against a plain recursive context-tree weighting."""

import math
import random

import numpy as np
import pytest

from crawlspan.llm import ctw as C
from crawlspan.llm import queries


def brute(corpus, texts, depth):
    """bits of each text by the textbook recursion, with dictionaries."""
    counts = {}
    for t in corpus:
        raw = bytes(depth) + t.encode()
        for i in range(depth, len(raw)):
            node = 1
            for k in range(8):
                bit = raw[i] >> (7 - k) & 1
                for d in range(depth + 1):
                    counts.setdefault((raw[i - d : i], node), [0, 0])[bit] += 1
                node = node * 2 + bit
    kids = {}
    for c, node in counts:
        if c:
            kids.setdefault((c[1:], node), []).append((c, node))
    memo = {}

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(key):
        if key not in memo:
            own = kt(*counts[key])
            memo[key] = own if len(key[0]) == depth else np.logaddexp(own + math.log(0.5), sum(weighted(k) for k in kids[key]) + math.log(0.5))
        return memo[key]

    def predict(c, node, bit, d):
        key = (c[len(c) - d :], node)
        n = counts.get(key, [0, 0])
        p = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return p
        share = math.exp(kt(*n) + math.log(0.5) - weighted(key)) if sum(n) else 0.5
        return share * p + (1 - share) * predict(c, node, bit, d + 1)

    out = []
    for t in texts:
        raw, bits = bytes(depth) + t.encode(), 0.0
        for i in range(depth, len(raw)):
            node = 1
            for k in range(8):
                bit = raw[i] >> (7 - k) & 1
                bits -= math.log2(predict(raw[i - depth : i], node, bit, 0))
                node = node * 2 + bit
        out.append(bits)
    return out


def texts():
    rnd = random.Random(6)
    vocab = ["the", "tree", "éa", "of", "ñandú", "stone\n", "x9"]
    return [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 40))) for _ in range(60)] + ["", "a", "aaaaaaaaaaaaaaaaaaaaa", "日本", "the tree"] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts())], "doc_id long, text string, bits double").repartition(5)


@pytest.mark.parametrize("depth", [2, 4, 7])
def test_equals_recursion(docs, depth):
    got = {r.doc_id: r for r in C.score(docs, depth=depth).collect()}
    for i, (t, bits) in enumerate(zip(texts(), brute(texts(), texts(), depth))):
        assert got[i].n_bytes == len(t.encode()) and got[i].bits == pytest.approx(bits, rel=1e-4, abs=1e-4)


def test_other_corpus_and_any_blocks(spark, docs, monkeypatch):
    other = ["the stone of the tree", "unseen zebra", ""]
    asked = spark.createDataFrame(list(enumerate(other)), "doc_id long, text string")
    expected = brute(texts(), other, 4)
    for block, bucket in ((C.BLOCK_BYTES, C.BUCKET_BYTES), (1, 1), (1 << 10, 64)):
        monkeypatch.setattr(C, "BLOCK_BYTES", block)
        monkeypatch.setattr(C, "BUCKET_BYTES", bucket)
        got = {r.doc_id: r.bits for r in C.score(asked, docs).collect()}
        assert [got[i] for i in range(3)] == pytest.approx(expected, rel=1e-4, abs=1e-4)


def test_awkward_rows(spark, docs):
    rows = spark.createDataFrame([(1, None), (1, None), (None, "the tree"), (2, "")], "doc_id long, text string")
    got = sorted(C.score(rows).collect(), key=lambda r: (r.n_bytes, str(r.doc_id)))
    assert [(r.doc_id, r.n_bytes, r.bits, r.bits_per_byte) for r in got[:3]] == [(1, 0, 0, None), (1, 0, 0, None), (2, 0, 0, None)]
    assert got[3].bits_per_byte == got[3].bits / 8
    assert C.score(rows.limit(0)).count() == 0
    assert [r.n_bytes for r in C.score(rows.filter("text is null or text = ''")).collect()] == [0, 0, 0]
    assert C.score(rows, rows.limit(0)).filter("doc_id is null").first().bits == pytest.approx(64)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 100.0, 12345.5, 1e9])
    assert C.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-10)


def test_query_reads_contexts_of_seven_bytes(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.bits for r in queries.QUERIES["op5_context_tree_weighting"](spark, sf).collect()}
    deep = {r.doc_id: r.bits for r in C.score(docs, depth=7).collect()}
    assert got == pytest.approx(deep, rel=1e-6) and sum(got.values()) < 0.95 * sum(r.bits for r in C.score(docs, depth=4).collect())


def test_text_longer_than_a_step_and_codes(monkeypatch):
    rnd = np.random.default_rng(4)
    body = rnd.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 0, 3, 2900, 5000])
    for depth in (2, 7):
        one, many = list(C.grams(body, offsets, depth)), list(C.grams(body, offsets, depth, 700))
        assert len(many) == 8 and np.array_equal(one[0], np.concatenate(many))
        assert [int(g) >> 56 for g in one[0][[0, 3, 2900]]] == [0, 0, 0] and int(one[0][5]) >> 56 == body[4]
    for x in (np.zeros(0), np.arange(5), rnd.integers(0, 1 << 62, 99)):
        assert np.array_equal(C._decoded(C._coded(x.astype(np.uint64))), x.astype(np.uint64))
