"""Signatures, trees, search recall and groups against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from crawlspan.llm import simhash as S
from crawlspan.llm import text as T


def brute_signature(text):
    words = set()
    word = bytearray()
    for b in text.lower().encode() + b" ":
        if T.WORD[b]:
            word.append(b)
        elif word:
            words.add(bytes(word))
            word.clear()
    total = np.zeros(S.BITS, int)
    for w in words:
        h = T.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])) >> np.uint64(24)
        total += np.unpackbits(np.stack([T.mix(h), T.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1).view(np.uint8)).astype(int) * 2 - 1
    return tuple(np.packbits(total > 0).view(np.uint64).tolist()) if words else None


def words(rnd, n):
    return ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def near(rnd, base, share):
    return [rnd.choice(words(rnd, 1)) if rnd.random() < share else w for w in base]


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(4)
    rows, truth = [], []
    for g in range(60):
        base = words(rnd, rnd.randrange(60, 300))
        members = [len(rows)]
        rows.append(" ".join(base))
        for _ in range(g % 4):
            members.append(len(rows))
            rows.append(" ".join(near(rnd, base, 0.03)) if rnd.random() < 0.7 else " ".join(base).upper() + " !!")
        truth.append(members)
    rows += [" ".join(words(rnd, 100)) for _ in range(200)]
    return rows, truth


def test_signature():
    rnd = random.Random(1)
    texts = ["", "!!", "one", "One one ONE", "été ÉTÉ", " ".join(words(rnd, 40)), "x" * 5000, " ".join(words(rnd, 3000) * 2)]
    body, offsets = T.flat(pa.array([t.lower() for t in texts]))
    got, some = S.sign(body, offsets)
    for t, g, s in zip(texts, got, some):
        expected = brute_signature(t)
        assert s == (expected is not None) and (not s or tuple(g.tolist()) == expected)


def test_signature_over_several_parts():
    rnd = random.Random(2)
    long = " ".join("".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(150_000))
    body, offsets = T.flat(pa.array(["a b c", long, long, "d e"]))
    got, _ = S.sign(body, offsets)
    one, _ = S.sign(*T.flat(pa.array(["a b c"])))
    assert (got[1] == got[2]).all() and (got[0] == one[0]).all()
    assert tuple(got[1].tolist()) == brute_signature(long)


@pytest.mark.parametrize("radius", [0, 3, 20])
def test_tree_search_is_exact(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (40, 2)).astype(np.uint64)
    rows = base[rng.integers(0, 40, 600)]
    for _ in range(8):
        flip = rng.integers(0, 128, len(rows))
        rows[np.arange(len(rows)), flip >> 6] ^= np.uint64(1) << (flip & 63).astype(np.uint64)
    group = np.sort(rng.integers(0, 5, len(rows)))
    parent, edge = S.build(rows, group)
    inner = parent != np.arange(len(rows))
    assert (S.distance(rows[inner], rows[parent[inner]]) == edge[inner]).all() and (group == group[parent]).all()
    assert len(set(zip(parent[inner], edge[inner]))) == inner.sum()
    found = {(int(a), int(b)) for q, n in S.search(rows, group, radius, chunk=500) for a, b in zip(q, n)}
    d = np.bitwise_count(rows[:, None] ^ rows[None]).sum(-1)
    assert found == {(i, j) for i in range(len(rows)) for j in range(i) if group[i] == group[j] and d[i, j] <= radius}


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(7, 7)]
    label = S.roots(1200, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    got = {r.u: r.root for r in S.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: int(x) for i, x in enumerate(label) if x != i}
    assert S.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups_equal_brute_force(spark, corpus):
    rows, truth = corpus
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(rows)], "doc_id long, text string, hi string").repartition(6)
    sig = [brute_signature(t) for t in rows]
    a = np.array(sig, np.uint64)
    d = np.bitwise_count(a[:, None] ^ a[None]).sum(-1)
    i, j = np.nonzero(np.triu(d <= S.RADIUS, 1))
    label = S.roots(len(rows), i, j)
    expected = {k: int(x) for k, x in enumerate(label) if x != k}
    got = {r.doc_id: r.keeper_id for r in S.duplicates(docs).collect()}
    agree = sum(got.get(k) == x for k, x in expected.items())
    assert agree >= 0.97 * len(expected) and not set(got) - set(expected)
    planted = [m for members in truth for m in members[1:]]
    assert sum(m in got for m in planted) >= 0.97 * len(planted)
    kept = S.accept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(rows))) - set(got)


@pytest.mark.parametrize("n", [8000, 10**6, 10**9])
def test_recall_at_the_radius_at_any_size(n):
    """Pairs at exactly RADIUS bits share a shard's key as often in the shards of a small table as of a large one."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, (3000, 2)).astype(np.uint64)
    twin = base.copy()
    flips = np.argsort(rng.random((len(twin), 128)), axis=1)[:, : S.RADIUS]
    for k in range(S.RADIUS):
        twin[np.arange(len(twin)), flips[:, k] >> 6] ^= np.uint64(1) << (flips[:, k] & 63).astype(np.uint64)
    assert (S.distance(base, twin) == S.RADIUS).all()
    bits, samples = S.sharding(n)
    keys = [S.shard_keys(x, S._positions(bits, samples)) for x in (base, twin)]
    assert (keys[0] == keys[1]).any(1).mean() >= S.RECALL - 0.01


def test_family_of_variants_is_one_group(spark):
    """Thousands of different signatures near one another: one group, found without a list of their pairs."""
    base = " ".join(f"word{i}" for i in range(400))
    docs = spark.range(3000).selectExpr("id as doc_id", f"concat('{base} ', sha2(cast(id as string), 256)) as text")
    rows = S.duplicates(docs).collect()
    assert len(rows) == 2999 and {(r.keeper_id, r.members) for r in rows} == {(0, 3000)}


def test_names_of_columns(spark):
    rows = [(1, "one two three", {"a b": 1}), (2, "One, two, three", {"a b": 2}), (3, "others are here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `content-type.x` map<string, int>").selectExpr("*", "named_struct('odd-name', 1, 'b c', 2) AS `_id`", "1 AS th", "2 AS keeper")
    kept = S.accept(docs)
    assert kept.dtypes == docs.dtypes and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_awkward_rows(spark):
    rows = [(5, "same text here"), (5, "same text here"), (2, "Same  TEXT here."), (None, "same text here"), (9, None), (9, None), (8, ""), (7, "?!"), (6, "quite another one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.keeper_id, r.members, r.exact) for r in S.duplicates(docs).collect()), key=str)
    assert got == [(5, 2, 4, True), (5, 2, 4, True), (None, 2, 4, True)]
    assert sorted(((r.doc_id, r.text) for r in S.accept(docs).collect()), key=str) == sorted([rows[2], *rows[4:]], key=str)
    twice = docs.filter("doc_id = 5").withColumn("_own", docs.text)
    assert S.accept(twice).count() == 1 and S.accept(docs.filter("doc_id is null").union(docs.filter("doc_id is null"))).count() == 1
    assert S.accept(docs.limit(0)).count() == 0 and S.duplicates(docs.limit(0)).count() == 0


def test_join_way_gives_the_same(spark, corpus, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(corpus[0])), "doc_id long, text string")
    a = {r.doc_id for r in S.accept(docs).collect()}
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert a == {r.doc_id for r in S.accept(docs).collect()}


def flipped(rng, words, n):
    """`words` with n bits of each row flipped."""
    out = words.copy()
    flips = np.argsort(rng.random((len(out), S.BITS)), axis=1)[:, :n]
    for k in range(n):
        out[np.arange(len(out)), flips[:, k] >> 6] ^= np.uint64(1) << (flips[:, k] & 63).astype(np.uint64)
    return out


def test_every_pair_at_the_radius_is_linked(spark, monkeypatch):
    """Signatures with one partner each, RADIUS bits away: none is left out."""
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63, (4000, 2)).view(np.uint64)
    rows = np.concatenate([base, flipped(rng, base, S.RADIUS)]).view(np.int64).tolist()
    docs = spark.createDataFrame([(i, f"{h} {w}") for i, (h, w) in enumerate(rows)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(S, "signatures", lambda d, text, key: d.selectExpr(key, f"cast(split({text}, ' ')[0] as long) as hi", f"cast(split({text}, ' ')[1] as long) as lo"))
    assert {(r.doc_id, r.keeper_id, r.members) for r in S.duplicates(docs).collect()} == {(4000 + i, i, 2) for i in range(4000)}


@pytest.mark.parametrize("radius, top", [(0, 3), (1, 0), (7, 2), (20, 0), (20, 5), (20, 18), (45, 4), (130, 1)])
def test_blocks_link_what_all_pairs_link(radius, top):
    """Families, large ones too, and unrelated signatures in shards of any number of names, against all pairs."""
    rng = np.random.default_rng(radius + top)
    base = rng.integers(-(2**63), 2**63, (150, 2)).view(np.uint64)
    rows = [base, *(flipped(rng, base, n) for n in {radius // 2, min(radius, 128), min(radius + 1, 128)}), flipped(rng, np.repeat(base[:1], 200, 0), min(radius // 2, 64))]
    rows = np.unique(np.concatenate(rows), axis=0)
    d = np.bitwise_count(rows[:, None] ^ rows[None]).sum(-1)
    places = S.blocks(radius)
    top = min(top, places.shape[1])
    names = S.shard_names(rows, places, top)
    edges = []
    for block in range(len(places)):
        for name in np.unique(names[:, block]):
            mine = np.flatnonzero((names[:, block] == name).any(1))
            least = S.linked(rows[mine], *S.variants(rows[mine], places[block], top, int(name)), radius)
            edges.append(np.stack([mine, mine[least]]))
    a, b = np.concatenate(edges, 1)
    assert (S.roots(len(rows), a, b) == S.roots(len(rows), *np.nonzero(d <= radius))).all()
