"""Recall against brute force, and awkward tables."""

import numpy as np
import pytest

from crawlspan.llm import ann as A


def exact(x, k):
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2500, 24)) + rng.standard_normal((12, 24))[rng.integers(0, 12, 2500)] * 1.5
    return x.astype(np.float32)


def test_graph_search(data):
    g = A.graph(data[:600])
    at, d = A.search(g, data[600:900], 8)
    true = np.argsort(A.squared(data[600:900], data[:600]), 1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(at, true)]) > 0.95
    assert (np.diff(d, axis=1) >= 0).all()
    at, d = A.search(A.graph(data[:1]), data[:3], 4)
    assert at[:, 0].tolist() == [0, 0, 0] and (at[:, 1:] == -1).all()


def test_recall(spark, data):
    df = spark.createDataFrame([(i, x.tolist(), "e") for i, x in enumerate(data)], "vec_id long, embedding array<float>, distance string").repartition(5)
    rows = A.neighbours(df, k=10).collect()
    assert len(rows) == 10 * len(data)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.rank] = r
    true = exact(data, 10)
    recall = np.mean([len({r.neighbour_id for r in got[i].values()} & set(true[i])) / 10 for i in range(len(data))])
    assert recall >= 0.9
    for i in range(0, len(data), 50):
        assert sorted(got[i]) == list(range(1, 11)) and all(got[i][k].distance <= got[i][k + 1].distance for k in range(1, 10))
        assert all(r.distance == pytest.approx(np.linalg.norm(data[i] - data[r.neighbour_id]), rel=1e-4, abs=1e-4) for r in got[i].values())


def test_awkward_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (3, [9.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, []), (6, [1.0]), (7, [float("nan"), 0.0]), (8, [0.0, 0.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.rank, r.neighbour_id, r.distance) for r in A.neighbours(df, k=2).collect())
    assert got == [(1, 1, 2, 0), (1, 2, 8, 0), (2, 1, 1, 0), (2, 2, 8, 0), (3, 1, 1, 1), (3, 2, 2, 1), (8, 1, 1, 0), (8, 2, 2, 0)]
    assert A.neighbours(df.limit(0)).count() == 0 and A.neighbours(df.filter("vec_id = 4")).count() == 0
    assert A.neighbours(df.filter("vec_id = 1")).count() == 0
    same = spark.range(500).selectExpr("id as vec_id", "array(1.0F, 2.0F) as embedding")
    assert A.neighbours(same, k=3).count() == 1500


def test_recall_with_far_more_lists_than_were_read(spark):
    """Some 800 lists, most of them within the ratio; of the nearest 128 alone a query has a part of its neighbours."""
    x = np.random.default_rng(5).standard_normal((4800, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in A.neighbours(df, df.filter("vec_id % 50 = 0"), list_size=6, probe_ratio=1.5).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    assert sorted(got) == list(range(0, len(x), 50))
    true = np.concatenate([exact_rows(x, i) for i in range(0, len(x), 400)])
    assert np.mean([len(s & set(true[i])) / 10 for i, s in got.items()]) >= 0.97


def test_hot_copies_and_their_blocks(spark, monkeypatch):
    """A third of the rows are copies of one vector, in blocks smaller than their list; queries are NULL, unknown and repeated ids too."""
    monkeypatch.setattr(A, "BLOCK_ROWS", 100)
    x = np.random.default_rng(6).standard_normal((900, 8)).astype(np.float32)
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(0,), (0,), (3,), (4,), (None,), (5000,)], "vec_id long")
    got = {}
    for r in A.neighbours(df, asked, list_size=20, probe_ratio=3.0).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id))
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == {i: exact(x, 10)[i].tolist() for i in (0, 3, 4)}


def exact_rows(x, i):
    d = A.squared(x[i : i + 400], x)
    d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
    return np.argsort(d, 1, kind="stable")[:, :10]


def test_within_is_all_within():
    rng = np.random.default_rng(4)
    g = A.graph(rng.standard_normal((3000, 16)).astype(np.float32))
    q = rng.standard_normal((20, 16)).astype(np.float32)
    d = A.squared(q, g.points)
    pairs = {(r, c) for row, col in A.within(g, q, 1.5) for r, c in zip(row, col)}
    assert pairs == set(zip(*np.nonzero(d <= 1.5**2 * A.search(g, q, 1)[1]))) and len(pairs) > 20 * 128
