"""Piece encoding, length histogram and packing against brute force."""

import random

import pytest
import sentencepiece

from crawlspan.llm import packing, pieces, token_counts

ODD = [None, "", "a", " ", "   a   b ", "\n", "\t\t\n x", "a" * 40, "ab" * 300, "😀 hi 😀😀", "日本語", "éàü ñ", " " * 37, "<s> </s> <0x41>", "ﬁ①", "\x00a\x01", "x" * 20001]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def texts():
    random.seed(3)
    mixed = ["".join(random.choice("ab  \nñ.,!ing the") for _ in range(random.randrange(90))) for _ in range(300)]
    return ODD + mixed + ["same"] * 5


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "other") for i, t in enumerate(texts())] + [(None, "no id", "other"), (3, " ", "id again")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)


def test_encode_equals_library(docs, library):
    for r in pieces.round_trip(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.tokens == library.encode(r.text or "") and r.exact and r.n_tokens == len(r.tokens)


def test_all_rows_come_back(docs):
    assert pieces.encode(docs).count() == docs.count()
    assert pieces.encode(docs.limit(0)).count() == 0


def test_decode(spark, docs):
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs.filter("doc_id > 3"))).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.filter("doc_id > 3").collect()}
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, tokens array<int>")).collect()[0].text == ""
    with pytest.raises(Exception, match="outside the vocabulary"):
        pieces.decode(spark.createDataFrame([(1, [99999])], "doc_id long, tokens array<int>")).collect()


def test_library_decodes_what_we_encode(library):
    m = pieces.model()
    assert m.decode(__import__("numpy").array(library.encode("naïve\tこ x")), __import__("numpy").array([0, len(library.encode("naïve\tこ x"))])).to_pylist() == ["naïve\tこ x"]


def test_histogram_sums(spark, docs, library):
    lengths = sorted(len(library.encode(r.text or "")) for r in docs.collect())
    hist = token_counts.histogram(docs)
    rows = {r.length: r for r in token_counts.suffix_sums(hist).collect()}
    assert set(rows) == set(lengths)
    for x, r in rows.items():
        assert r.n_docs == lengths.count(x)
        assert r.docs_over == sum(y > x for y in lengths) and r.tokens_over == sum(y for y in lengths if y > x)
        assert r.truncated_total == sum(min(x, y) for y in lengths)
        assert r.quantile == sum(y <= x for y in lengths) / len(lengths)
    for r in token_counts.totals_at(hist, [0, 7, 10**6]).collect():
        assert r.truncated_total == sum(min(r.context_limit, y) for y in lengths)
        assert r.docs_cut == sum(y > r.context_limit for y in lengths)
    median = token_counts.quantiles(hist, [0.5]).collect()[0].length
    assert median == min(x for x in lengths if sum(y <= x for y in lengths) >= len(lengths) / 2)
    assert token_counts.suffix_sums(token_counts.histogram(docs.limit(0))).count() == 0


@pytest.mark.parametrize("width", [1, 7, 64, 100000])
def test_packing_is_concatenate_and_cut(docs, library, width):
    if width == 1:
        docs = docs.filter("length(text) < 50 or text is null")
    out = sorted(packing.pack(docs, width=width).collect(), key=lambda r: r.window_id)
    assert [r.window_id for r in out] == list(range(len(out)))
    assert all(r.n_tokens == width for r in out[:-1]) and len(out[-1].tokens) <= width
    stream = [t for r in out for t in r.tokens]
    expected = sorted((r.doc_id if r.doc_id is not None else -1, tuple(library.encode(r.text or "") + [2])) for r in docs.collect())
    at, got = 0, []
    for r in out:
        assert r.starts[0] == 0 and sum(r.lengths) == len(r.tokens)
        for d, s, n in zip(r.doc_ids, r.doc_starts, r.lengths):
            if s == 0:
                got.append((d if d is not None else -1, []))
            assert len(got[-1][1]) == s
            got[-1][1].extend(stream[at : at + n])
            at += n
    assert sorted((d, tuple(t)) for d, t in got) == expected


def test_packing_of_nothing(docs):
    assert packing.pack(docs.limit(0)).count() == 0


def test_string_ids_are_packed(spark, library):
    docs = spark.createDataFrame([("a-1", "some words"), (None, "other words"), ("b", None)], "doc_id string, text string").coalesce(1)
    (row,) = packing.pack(docs).collect()
    assert row.doc_ids == ["a-1", None, "b"] and row.n_tokens == sum(len(library.encode(t)) + 1 for t in ("some words", "other words", ""))


def test_long_words_that_collide(spark, library):
    """Thue-Morse words of 2,048 letters have one hash under any polynomial modulo 2 ** 64."""
    t = [bin(i).count("1") & 1 for i in range(2048)]
    a, b = "".join("ab"[x] for x in t), "".join("ba"[x] for x in t)
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.tokens for r in pieces.encode(docs).collect()} == {1: library.encode(a), 2: library.encode(b)}
