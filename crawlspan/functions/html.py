"""Links, images and text of HTML: one scan of its tags, in Arrow batches.

The scan is tolerant: unclosed and crossed elements, bare attributes, comments
and raw script or style text don't upset it. Entities are resolved.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlspan.session import ship_active

_NAME = re.compile(r"<(/?)([a-z][^\s/>]*)", re.I)
_REST = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_RAW = re.compile(r"<(script|style)\b", re.I)
_RAW_END = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_SPECIAL = re.compile(r"[\"'>]")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data dfn em font i img input kbd label mark q s samp select small span strike strong sub sup time tt u var".split())
_SPACE = re.compile(r"\s+")
_SCHEME = re.compile(r"(?i)^(https?|ftp|file)://|^mailto:")

LINKS = "array<struct<src:string,dst:string,anchor:string>>"


def resolve(base: str, target: str) -> str:
    """`target` as an absolute URL, or '' if it has none of the known schemes."""
    try:
        out = urljoin(base, target.strip())
    except ValueError:
        return ""
    return out if _SCHEME.match(out) else ""


def attributes(body: str) -> dict[str, str]:
    """Attributes of a tag by lower-case name; of a repeated one, the first."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(body):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


class _Closes:
    """Where a tag ends whose text behind the name begins at a place: the first > outside quotes, or -1.

    Tags are matched one by one until one has no end; from then on the answers
    for the whole page are worked out once, from its end to its begin, so that a
    page of unclosed tags takes linear time.
    """

    def __init__(self, html: str):
        self.html, self.at, self.close = html, None, []

    def __call__(self, i: int) -> int:
        if self.at is None:
            if m := _REST.match(self.html, i):
                return m.end() - 1
            self._prepare()
        k = bisect_left(self.at, i)
        return self.close[k] if k < len(self.at) else -1

    def _prepare(self) -> None:
        self.at = [m.start() for m in _SPECIAL.finditer(self.html)]
        self.close = [-1] * (len(self.at) + 1)
        later: dict[str, int] = {}
        for k in range(len(self.at) - 1, -1, -1):
            c = self.html[self.at[k]]
            if c == ">":
                self.close[k] = self.at[k]
            else:
                self.close[k] = self.close[later[c] + 1] if c in later else -1
                later[c] = k


def scan(html: str):
    """(tag, closing, attribute text, text before it) in document order; at the end tag is ''. One pass over the text."""
    at = pos = 0
    last, ends = html.rfind(">"), _Closes(html)
    while (i := html.find("<", pos)) >= 0:
        tag, closing, body, end = "!", False, "", -1
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            end = len(html) if end < 0 else end + 3
        elif i > last:  # no tag ends any more
            if (i := html.find("<!--", i)) < 0:
                break
            end = len(html)
        elif m := _RAW.match(html, i):
            tag = m[1].lower()
            found = _RAW_END[tag].search(html, html.find(">", i) + 1)
            end = found.end() if found else len(html)
        elif m := _NAME.match(html, i):
            if (stop := ends(m.end())) >= 0:
                tag, closing, body, end = m[2].lower(), m[1] == "/", html[m.end() : stop], stop + 1
        elif html[i + 1 : i + 2] in ("!", "?"):
            end = html.find(">", i) + 1
        if end < 0:
            pos = i + 1
            continue
        yield tag, closing, body, html[at:i]
        at = pos = end
    yield "", False, "", html[at:]


def _squeeze(parts: list[str]) -> str:
    return _SPACE.sub(" ", "".join(parts)).strip()


def links_of(src: str | None, html: str | None, base: str | None = "") -> list[dict[str, str]]:
    """Anchors with a target, in order; relative ones vanish without a base."""
    out: list[dict[str, str]] = []
    if src is None or not html:
        return out
    dst, words = None, []

    def close() -> None:
        if dst:
            out.append({"src": src, "dst": dst, "anchor": _squeeze(words)})

    for tag, closing, body, text in scan(html):
        if dst is not None:
            words.append(unescape(text))
            if tag and tag not in _INLINE:
                words.append(" ")
        if tag in ("a", ""):
            close()
            dst, words = None, []
            if tag and not closing:
                href = attributes(body).get("href")
                dst = resolve(base or "", href) if href is not None else None
    return out


def images_of(src: str | None, html: str | None) -> list[str]:
    """Targets of images against the page's URL, in order; '' where that can't be resolved."""
    if src is None or not html:
        return []
    found = (attributes(body).get("src") for tag, closing, body, _ in scan(html) if tag == "img" and not closing)
    return [resolve(src, x) for x in found if x is not None]


def text_of(html: str | None) -> str | None:
    """Visible text; block elements and line breaks part words, inline ones don't."""
    if html is None:
        return None
    parts: list[str] = []
    for tag, _, _, text in scan(html):
        parts.append(unescape(text))
        if tag not in _INLINE and tag != "!":
            parts.append(" ")
    return _squeeze(parts)


def main_text_of(html: str | None, least_words: int = 10, most_links: float = 1 / 3) -> str | None:
    """Text of the blocks that are content by word count and link density, judged with their neighbours; None if none is."""
    if not html:
        return None
    blocks: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked, inside = 0, False
    for tag, closing, _, text in scan(html):
        words = unescape(text)
        parts.append(words)
        if inside:
            linked += len(words.split())
        if tag == "a":
            inside = not closing
        elif tag not in _INLINE and tag != "!":
            block = _squeeze(parts)
            if block:
                blocks.append((block, len(block.split()), linked))
            parts, linked = [], 0
    keep = []
    for i, (block, n, in_links) in enumerate(blocks):
        dense = lambda k: blocks[k][2] / blocks[k][1] if 0 <= k < len(blocks) else 0.0
        size = lambda k: blocks[k][1] if 0 <= k < len(blocks) else 0
        if in_links / n > most_links:
            continue
        if dense(i - 1) <= 0.56:
            content = n > 16 or size(i + 1) > 15 or size(i - 1) > 4 and n >= least_words
        else:
            content = n > 40 or size(i + 1) > 17
        if content:
            keep.append(block)
    return " ".join(keep) or None


def _udf(f, kind: str, arrow: pa.DataType):
    ship_active()

    @F.arrow_udf(kind)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([f(*row) for row in zip(*(c.to_pylist() for c in columns))], arrow)

    return run


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


_LINK = pa.list_(pa.struct([("src", pa.string()), ("dst", pa.string()), ("anchor", pa.string())]))


def extract_links(src: Column | str, html: Column | str, base: Column | str | None = None) -> Column:
    """ARRAY<STRUCT<src, dst, anchor>>; without a base relative links vanish."""
    return _udf(links_of, LINKS, _LINK)(_c(src), _c(html), F.lit("") if base is None else _c(base))


def extract_image_links(src: Column | str, html: Column | str) -> Column:
    return _udf(images_of, "array<string>", pa.list_(pa.string()))(_c(src), _c(html))


def remove_html(html: Column | str) -> Column:
    return _udf(text_of, "string", pa.string())(_c(html))


def main_text(html: Column | str) -> Column:
    """Text without boilerplate, NULL if nothing is left."""
    return _udf(main_text_of, "string", pa.string())(_c(html))
