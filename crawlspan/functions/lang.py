"""Language identification by ranked character n-grams (Cavnar and Trenkle)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspan.session import ship_active

#: The first article of the Universal Declaration of Human Rights, with common words, by ISO code.
SAMPLES = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. the of and to in is that it was for on with as be at by this had not but from have they which or were",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. le la les de des du et un une est que qui dans pour par sur avec au aux ne pas ce il elle nous vous",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. der die das und ist von zu den mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. el la los las de que y en un una es por con para no se lo del al como más su pero sus le ya o este",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. il lo la i gli le di che e un una è per con non si del della nel sono come più anche ma da",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. o a os as de que e do da em um uma é para com não se na no por mais dos das como mas ao ele",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. de het een en van ik te dat die in is niet zijn op aan met als voor had er maar om hem dan zou of wat",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap. och i att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan",
}
SIZE = 400

_WORD = re.compile(r"[^\W\d_]+")


def ranked(text: str, size: int = SIZE) -> dict[str, int]:
    """Rank of the commonest 1- to 3-grams of padded lower-case words, ties by gram."""
    counts: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        padded = f"_{word}_"
        for k in (1, 2, 3):
            for i in range(len(padded) - k + 1):
                counts[padded[i : i + k]] += n
    counts.pop("_", None)
    return {g: r for r, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}


PROFILES = {code: ranked(text) for code, text in SAMPLES.items()}


def detect(text: str | None, profiles: dict[str, dict[str, int]] | None = None) -> str:
    """Code of the profile at the least out-of-place distance, ties by code; '' without letters."""
    mine = ranked(text or "")
    if not mine:
        return ""
    far = SIZE
    distance = lambda p: sum(abs(r - p[g]) if g in p else far for g, r in mine.items())
    return min((distance(p), code) for code, p in sorted((profiles or PROFILES).items()))[1]


#: Of each code point: whether it is of a word by _WORD, of one by \p{L}, and whether it was looked up; 0 before.
_KIND = np.zeros(0x110000, np.uint8)
WORD, LETTER, KNOWN = 1, 2, 4
#: Texts whose grams are counted at once, at most, and their characters, about.
_TEXTS, _CHARS = 512, 1 << 16


def _kinds(codes: np.ndarray) -> np.ndarray:
    found = _KIND[codes]
    if not found.all():
        for c in np.unique(codes[found == 0]).tolist():
            x = chr(c)
            _KIND[c] = KNOWN | (WORD if _WORD.match(x) else 0) | (LETTER if category(x)[0] == "L" else 0)
        found = _KIND[codes]
    return found


def counted(texts: list[str], kind: int = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, number) of all 1- to 3-grams of the padded words of at most _TEXTS texts, by text and gram.

    A gram is a number of up to three code points of 21 bits from the highest
    on, so that numbers have the order of the strings.
    """
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = np.concatenate([[False], (_kinds(codes) & kind) > 0, [False]])
    up, down = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    if not len(up):
        return (np.zeros(0, np.int64),) * 3
    size = down - up + 2
    begin = np.cumsum(size) - size
    here = np.zeros(int(codes.max()) + 1 + ord("_"), bool)
    here[codes[inside[1:-1]]] = here[ord("_")] = True
    letters, rank = np.flatnonzero(here), np.cumsum(here)
    width = len(letters).bit_length()
    padded = np.full(int(size.sum()), rank[ord("_")])
    body = np.ones(len(padded), bool)
    body[begin] = body[begin + size - 1] = False
    padded[body] = rank[codes[inside[1:-1]]]
    who = np.repeat(np.searchsorted(ends, up, "right"), size) << 3 * width
    one = who + (padded << 2 * width)
    two = (one[:-1] + (padded[1:] << width))[~_last(begin, size, len(padded), 1)[:-1]]
    three = (one[:-2] + (padded[1:-1] << width) + padded[2:])[~_last(begin, size, len(padded), 2)[:-2]]
    every = np.concatenate([one[body], two, three])
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    gram, mask, letters = every[first], (1 << width) - 1, np.append(0, letters).astype(np.int64)
    number = letters[gram >> 2 * width & mask] << 42 | letters[gram >> width & mask] << 21 | letters[gram & mask]
    return gram >> 3 * width, number, np.diff(np.append(first, len(every)))


def _last(begin: np.ndarray, size: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of n places, the last k of each word."""
    out = np.zeros(n, bool)
    for i in range(1, k + 1):
        out[begin + size - i] = True
    return out


def _number(gram: str) -> int:
    return sum(ord(c) << 21 * (2 - i) for i, c in enumerate(gram))


def _string(number: int) -> str:
    return "".join(chr(c) for c in (number >> 42, number >> 21 & 0x1FFFFF, number & 0x1FFFFF) if c)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if len(held) == _TEXTS or size >= _CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def detect_all(texts: list[str | None], profiles: dict[str, dict[str, int]] | None = None) -> list[str]:
    """`detect` of each text, many at once."""
    named = sorted((profiles or PROFILES).items())
    known = np.unique(np.array([_number(g) for _, p in named for g in p], np.int64))
    ranks = np.full((len(named), len(known) + 1), -1, np.int64)
    for i, (_, p) in enumerate(named):
        ranks[i, np.searchsorted(known, np.array([_number(g) for g in p], np.int64))] = list(p.values())
    known, out = np.append(known, np.iinfo(np.int64).max), []
    for some in _slices([(t or "").lower() for t in texts]):
        who, gram, n = counted(some)
        order = np.argsort((who << 40) - n, kind="stable")
        who, gram = who[order], gram[order]
        begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else who
        place = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
        top = place < SIZE
        who, gram, place = who[top], gram[top], place[top]
        at = np.searchsorted(known, gram)
        at[known[at] != gram] = len(known) - 1
        codes = [""] * len(some)
        if len(who):
            begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            far = np.array([np.add.reduceat(np.where(r[at] < 0, SIZE, np.abs(place - r[at])), begin) for r in ranks])
            for t, k in zip(who[begin].tolist(), far.argmin(axis=0).tolist()):
                codes[t] = named[k][0]
        out += codes
    return out


def train_profiles(texts: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> dict[str, dict[str, int]]:
    """Profiles of labelled texts, counted over all of them; `size` grams a language are collected."""
    rows = texts.select(F.col(lang).cast("string").alias("lang"), F.lower(text).alias("t")).filter("t IS NOT NULL")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str | None, list[str]] = {}
            for code, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(code, []).append(t)
            for code, own in by.items():
                found = [counted(some, LETTER)[1:] for some in _slices(own)]
                gram, n = (np.concatenate(c) for c in zip(*found))
                gram, which = np.unique(gram, return_inverse=True)
                total = np.zeros(len(gram), np.int64)
                np.add.at(total, which, n)
                yield pa.RecordBatch.from_arrays([pa.array([code] * len(gram), pa.string()), pa.array(list(map(_string, gram.tolist())), pa.string()), pa.array(total)], ["lang", "g", "n"])

    ship_active()
    counts = rows.mapInArrow(grams, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    top = counts.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "g"))), 1, size).alias("t"))
    return {r.lang: {x["g"]: k for k, x in enumerate(r.t)} for r in top.collect() if r.lang is not None}


def detect_language(text: Column | str, profiles: dict[str, dict[str, int]] | None = None) -> Column:
    """ISO code of a text's language, '' for none."""
    ship_active()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(detect_all(column.to_pylist(), profiles), pa.string())

    return run(F.col(text) if isinstance(text, str) else text)
