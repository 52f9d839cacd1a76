"""The stages in order on a small corpus, each against what it must do."""

import random

import pytest

import corpus_pipeline as P
from crawlspan.llm import pieces, queries, substring

BAD = "grubzal"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmn") for _ in range(rnd.randrange(3, 9)))
    texts, kind = [], []

    def add(t, k):
        texts.append(t)
        kind.append(k)

    shared = " ".join(word() for _ in range(70))
    for i in range(240):
        words = [word() for _ in range(rnd.randrange(60, 160))]
        if i % 8 == 0:
            words.insert(5, BAD)
            add(" ".join(words), "toxic")
        elif i % 8 == 1:
            add(" ".join(w + "&&&" for w in words), "junk")
        elif i % 8 == 2:
            add(" ".join(words), "original")
            add(" ".join(words).title(), "copy")
        elif i % 8 == 3:
            add(" ".join(words[:30]) + " " + shared + " " + " ".join(words[30:]), "shared")
        else:
            add(" ".join(words), "clean")
    add(None, "null")
    add("", "empty")
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(k == "toxic")) for i, k in enumerate(kind) if i % 2 == 0 or k == "toxic" and i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), kind, shared


def test_stages(spark, sf_dir, tmp_path):
    path, kind, shared = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, after = docs.columns, {}
    for name, f in P.STAGES:
        f(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    ids = {n: {r.doc_id for r in rows} for n, rows in after.items() if n != "packing"}
    of = lambda k: {i for i, x in enumerate(kind) if x == k}
    everything = set(range(len(kind)))
    assert len(of("toxic") & ids["toxicity"]) <= 1 and everything - of("toxic") <= ids["toxicity"]
    assert ids["quality_rules"] == ids["toxicity"] - of("junk") - of("null") - of("empty")
    gone = ids["quality_rules"] - ids["simhash_near_dedup"]
    assert gone == of("copy") and of("clean") | of("original") <= ids["simhash_near_dedup"]
    assert ids["substring_dedup"] == ids["simhash_near_dedup"]
    holders = [r for r in after["substring_dedup"] if shared in r.text]
    assert len(holders) == 1 and all(r.n_chars == len(r.text) for r in after["substring_dedup"])
    before = {r.doc_id: r.text for r in after["simhash_near_dedup"]}
    assert all(r.text == before[r.doc_id] for r in after["substring_dedup"] if r.doc_id not in of("shared"))
    tokens = sum(r.n_tokens for r in after["packing"])
    m = pieces.model()
    assert tokens == sum(r.n_tokens + 1 for r in pieces.token_counts(spark.read.parquet(f"{tmp_path}/substring_dedup")).collect()) and m.size == 32000
    assert substring.passages(spark.read.parquet(f"{tmp_path}/substring_dedup")).count() == 0


def test_run_is_the_stages(spark, sf_dir):
    rows = P.run(spark, sf_dir[0])
    assert rows.columns == ["window_id", "tokens", "n_tokens", "doc_ids", "doc_starts", "starts", "lengths"] and rows.count() > 5
    assert queries.QUERIES["pipeline"] is P.run and P.ORACLE_SQL is None


def test_nothing_in_nothing_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet").limit(0)
    for _, f in P.STAGES:
        out = f(spark, docs, sf_dir[0])
        assert out.count() == 0


def test_passages_whose_pieces_many_hold_stay_once(spark):
    """Of 50 words that two documents share, others hold every piece of 40: one of the two alone keeps them."""
    rnd = random.Random(5)
    words = lambda n: ["".join(rnd.choice("abcdefghijklmn") for _ in range(rnd.randrange(3, 9))) for _ in range(n)]
    rows, shared = [], [words(50) for _ in range(8)]
    for p in shared:
        rows += [words(60) + p[i : i + 40] + words(60) for i in range(11) for _ in range(3)] + [words(60) + p + words(60) for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    after = [r.text for r in P.cut_repeats(spark, docs, "").collect()]
    assert len(after) == len(rows) and [sum(" ".join(p) in t for t in after) for p in shared] == [1] * 8
