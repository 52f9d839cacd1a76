"""Held-out accuracy, scores against brute force, and awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlspan.llm import toxicity as X

WORDS = ["river", "stone", "éclat", "meadow", "window", "garden", "letter", "winter", "bridge", "silver"]
BAD = ["grubzal", "морж", "fietrop"]


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(WORDS) + rnd.choice(["", "s", "ly"]) for _ in range(rnd.randrange(5, 120))]
        bad = i % 4 == 0
        if bad:
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD).upper() if i % 8 else rnd.choice(BAD))
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = corpus(600, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(10**6, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, toxic int, text int")
    return X.train(docs, labels)


def test_held_out(spark, trained):
    rows = corpus(400, 2)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, toxicity string")
    found = {r.doc_id for r in X.toxic(docs, trained).collect()}
    truth = {i for i, _, y in rows if y}
    assert len(found & truth) >= 0.97 * len(truth) and len(found - truth) <= 2
    kept = X.accept(docs, trained)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - found


def test_brute_force(spark, trained):
    weight = dict(zip(trained.buckets.tolist(), trained.weights))

    def brute(text):
        codes, held = [ord(c) for c in text.lower()], set()
        for n in X.ORDERS:
            for i in range(len(codes) - n + 1):
                h = 0
                for c in codes[i : i + n]:
                    h = (h * 0x100000001B3 + c) % 2**64
                held.add((((h + n) * 0x9E3779B97F4A7C15) % 2**64) >> (64 - X.BITS))
        return 1 / (1 + np.exp(-(trained.bias + sum(weight.get(b, 0) for b in held))))

    texts = [t for _, t, _ in corpus(30, 5)] + ["", "a", "grubzal", "ab", "river " * 5000 + "grubzal"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in X.scores(docs, trained).collect():
        assert r.toxicity == pytest.approx(brute(texts[r.doc_id]), abs=1e-5)


def test_awkward_rows(spark, trained):
    docs = spark.createDataFrame([(1, None), (1, None), (None, "grubzal grubzal"), (2, "")], "doc_id long, text string")
    assert X.scores(docs, trained).count() == 4
    assert [r.doc_id for r in X.toxic(docs, trained).collect()] == [None]
    assert X.accept(docs, trained).count() == 3 and X.accept(docs.limit(0), trained).count() == 0


@pytest.mark.parametrize("keep", ["toxic = 1", "toxic = 0", "toxic > 1"])
def test_one_class_rejects_nothing(spark, keep):
    rows = corpus(40, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").filter(keep)
    model = X.train(docs, labels)
    assert X.toxic(docs, model).count() == 0 and X.scores(docs, model).filter(F.col("toxicity").isNull()).count() == 0


def test_few_labels_are_learnt_from(spark):
    """24 texts: no n-gram can differ by 5 standard errors there."""
    rows = corpus(24, 6)
    docs = spark.createDataFrame([(i, t.lower().replace("морж", "grubzal").replace("fietrop", "grubzal")) for i, t, _ in rows], "doc_id long, text string")
    model = X.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert {r.doc_id for r in X.toxic(docs, model).collect()} == {i for i, _, y in rows if y}


def test_names_of_columns(spark, trained):
    docs = spark.createDataFrame([(1, "river stone", {"a b": 1}), (2, "a grubzal here grubzal", None)], "doc_id long, text string, `content-type.x` map<string, int>")
    docs = docs.selectExpr("*", "named_struct('odd-name', 1, 'b c', 2) AS _row", "0.0D AS toxicity", "1 AS _t")
    kept = X.accept(docs, trained)
    assert kept.dtypes == docs.dtypes and [r.doc_id for r in kept.collect()] == [1]


def test_coefficients_against_gradient_descent():
    rng = np.random.default_rng(8)
    held = rng.random((200, 6)) < 0.3
    value = rng.normal(size=6)
    y = (held @ value + rng.normal(size=200) > 0.2).astype(float)
    row, column = np.nonzero(held)
    coef, bias = X._logistic(row, column, value, y, 1e-2)
    w, b = np.zeros(6), 0.0
    x = held * value
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w - 0.5 * (x.T @ (p - y) / 200 + 1e-2 * w), b - 0.5 * (p - y).mean()
    assert np.allclose(coef, w, atol=1e-3) and abs(bias - b) < 1e-3


def test_ratios_against_counts(spark, trained):
    """The weight of an n-gram is its coefficient times the log ratio of its shares: signs and choice follow from plain counts."""
    rows = corpus(600, 1)
    body, offsets = X.T.flat(X.pa.array([t.lower() for _, t, _ in rows]))
    row, bucket = X.features(body, offsets)
    y = np.array([y for *_, y in rows])
    y[3] = 0
    toxic, clean = (np.bincount(bucket[y[row] == k], minlength=1 << X.BITS) for k in (1, 0))
    ratio = np.log((toxic + 1) / (y.sum() + 1)) - np.log((clean + 1) / (600 - y.sum() + 1))
    pool = (toxic + clean) / 600
    with np.errstate(all="ignore"):
        z = (toxic / y.sum() - clean / (600 - y.sum())) / np.sqrt(pool * (1 - pool) * (1 / y.sum() + 1 / (600 - y.sum())))
    assert set(trained.buckets) == set(np.flatnonzero((np.abs(z) >= 5) & (np.abs(ratio) >= np.log(2)) & (pool < 1)))
