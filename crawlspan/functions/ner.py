"""Named entities behind a pluggable tagger."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlspan.session import ship_active

TYPES = ("PERSON", "ORGANIZATION", "LOCATION")

#: A tagger gives (token, type) of each token of a text, sentence by sentence; type 'O' is none.
Tagger = Callable[[str], list[list[tuple[str, str]]]]

_TOKEN = re.compile(r"[^\W_]+(?:[.'&-][^\W_]+)*|[^\w\s]")
_SHORT = re.compile(r"\b(Mr|Mrs|Ms|Dr|Prof|Sen)\.")
_TITLE = frozenset("mr mrs ms dr prof president senator minister sir lady judge".split())
_ORG = frozenset("inc corp ltd llc university college institute company foundation committee council ministry department bank association agency party press archive".split())
_PLACE = frozenset("street avenue river lake mount city county island bay valley sea ocean".split())
_BEFORE_PLACE = frozenset("in at near from to".split())


def rule_tagger(people: frozenset[str] = frozenset(), organizations: frozenset[str] = frozenset(), places: frozenset[str] = frozenset()) -> Tagger:
    """Tags by word lists, titles, and the words around runs of capitalised ones."""

    def tag(text: str) -> list[list[tuple[str, str]]]:
        out = []
        for sentence in re.split(r"(?<=[.!?])\s+", _SHORT.sub(r"\1", text)):
            tokens = _TOKEN.findall(sentence)
            kinds = ["O"] * len(tokens)
            i = 0
            while i < len(tokens):
                j = i
                while j < len(tokens) and tokens[j][:1].isupper():
                    j += 1
                if j == i:
                    i += 1
                    continue
                run = tokens[i:j]
                low = [t.lower().rstrip(".") for t in run]
                name, before = " ".join(run), tokens[i - 1].lower() if i else ""
                kind = "O"
                if name in places or any(t in _PLACE for t in low[1:]):
                    kind = "LOCATION"
                elif name in organizations or any(t in _ORG for t in low):
                    kind = "ORGANIZATION"
                elif name in people or low[0] in _TITLE and len(run) > 1 or run[0] in people:
                    kind = "PERSON"
                elif before in _BEFORE_PLACE and len(run) <= 2:
                    kind = "LOCATION"
                start = i + 1 if kind == "PERSON" and low[0] in _TITLE else i
                kinds[start:j] = [kind] * (j - start)
                i = j
            out.append(list(zip(tokens, kinds)))
        return out

    return tag


def entities(text: str | None, tagger: Tagger) -> dict[str, list[str]]:
    """Entities by type in order; adjacent tokens of one type within a sentence are one entity."""
    found: dict[str, list[str]] = {t: [] for t in TYPES}
    for sentence in tagger(text) if text else ():
        last, words = "O", []
        for token, kind in [*sentence, ("", "O")]:
            if kind != last and words:
                found[last].append(" ".join(words))
                words = []
            if kind in found:
                words.append(token)
            last = kind
    return found


def classify(text: Column | str, tagger: Tagger | None = None) -> Column:
    """JSON object of the entities by type; empty lists for NULL."""
    ship_active()
    tagger = tagger or rule_tagger()

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([json.dumps(entities(x, tagger), ensure_ascii=False) for x in column.to_pylist()], pa.string())

    return run(F.col(text) if isinstance(text, str) else text)


def extract_entities(df: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """date, url, entities (JSON) of (date, url, content) rows."""
    return df.select("date", "url", classify("content", tagger).alias("entities"))


def entity_rows(df: DataFrame) -> DataFrame:
    """date, domain, ner_type, entity: one row a mention, of `extract_entities` rows."""
    from crawlspan.functions.url import extract_domain

    parsed = df.select("date", extract_domain("url").alias("domain"), F.explode(F.from_json("entities", "map<string,array<string>>")).alias("ner_type", "e"))
    return parsed.select("date", "domain", "ner_type", F.explode("e").alias("entity"))


_LISTS = {"PERSON": "pers", "ORGANIZATION": "org", "LOCATION": "loc"}


def split_lists(lines: DataFrame, *also: Column) -> DataFrame:
    """Columns `also` of the line, date, kind (pers, org, loc), entity of lines `... {PERSON=[a, b], ORGANIZATION=[..], LOCATION=[..]} ...`; date: the first eight digits of a line."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("value", f"{t}=\\[([^\\]]*)\\]", 1).alias("list")) for t, k in _LISTS.items()]))
    rows = lines.select(*also, F.nullif(F.regexp_extract("value", r"(\d{8})", 1), F.lit("")).alias("date"), each.alias("x"))
    return rows.select(*rows.columns[:-1], "x.kind", F.explode(F.split("x.list", ", ")).alias("entity")).filter("entity != ''")
