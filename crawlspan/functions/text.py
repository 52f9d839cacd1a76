"""Date, text and pattern functions as Column expressions."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class DateComponent(Enum):
    """Parts of a yyyyMMdd date: first position and length."""

    YYYY = (1, 4)
    MM = (5, 2)
    DD = (7, 2)
    YYYYMM = (1, 6)
    YYYYMMDD = (1, 8)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract_date(full: Column | str, component: DateComponent = DateComponent.YYYYMMDD) -> Column:
    """A component of a date; NULL stays NULL, a part beyond the end is ''."""
    return F.substring(_c(full), *component.value)


def remove_http_header(content: Column | str) -> Column:
    """The body behind the first blank line of a text that begins with HTTP/; other texts unchanged."""
    c = _c(content)
    at = F.locate("\r\n\r\n", c)
    return F.when(c.startswith("HTTP/") & (at > 0), F.substring(c, at + 4, F.length(c))).otherwise(c)


def extract_urls(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit("https?://[^ ]+"), F.lit(0))


def extract_hashtags(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit("#[^ ]+"), F.lit(0))


def extract_mentions(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit("@[A-Za-z_0-9]+"), F.lit(0))


def content_string(content: Column | str) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(_c(content).cast("string"))


def warc_mime(content: Column | str) -> Column:
    """The first Content-Type anywhere in a block, without a trailing semicolon; NULL if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(_c(content), r"(?i)Content-Type: ([^\s]+)", 1), ";$", ""), F.lit(""))


def image_bytes(content: Column | str) -> Column:
    """Bytes behind the header of a response, found in the bytes themselves; other content unchanged."""
    c = _c(content)
    hex_at = F.regexp_extract(F.hex(c), "^((?:..)*?)0D0A0D0A", 1)
    ended = F.hex(c).rlike("^(?:..)*?0D0A0D0A")  # at whole bytes
    cut = F.length(hex_at) / 2 + 5
    return F.when((F.hex(F.substring(c, 1, 5)) == "485454502F") & ended, F.substring(c, cut.cast("int"), F.octet_length(c))).otherwise(c)


def excerpt(text: Column | str, mime: Column | str) -> Column:
    """First hundred characters of a text/* body without its first run of white space or any line ends; NULL otherwise."""
    rest = F.concat(F.regexp_extract(_c(text), r"(?s)^(\S*)\s+", 1), F.regexp_extract(_c(text), r"(?s)^\S*\s+(.*)$", 1))
    rest = F.when(_c(text).rlike(r"\s"), rest).otherwise(_c(text))
    return F.when(_c(mime).startswith("text"), F.regexp_replace(F.substring(rest, 1, 100), r"[\n\r]+", ""))


def parse_instant(digits: Column | str) -> Column:
    """yyyyMMddHHmmss as a UTC timestamp; NULL if it is none."""
    return F.try_to_timestamp(_c(digits), F.lit("yyyyMMddHHmmss"))


def format_instant(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyyMMddHHmmss")


def crawl_label(month: Column | str) -> Column:
    """200510 -> 05/10."""
    return F.regexp_replace(_c(month), r"^\d\d(\d\d)", "$1/")


def short_label(name: Column | str, size: int = 20) -> Column:
    c = _c(name)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def log_strength(count: Column | str) -> Column:
    """ln of a link's count."""
    return F.ln(_c(count))


def node_radius(page_rank: Column | str, count: Column | str) -> Column:
    return 1 + _c(page_rank) * F.ln(_c(count)) * 20


def md5_hex(content: Column | str) -> Column:
    return F.md5(_c(content))


def _leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        name = f"{prefix}`{f.name}`"
        out += _leaves(f.dataType, name + ".") if isinstance(f.dataType, T.StructType) else [name]
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Every leaf of nested structs as a column of its own, named by its path with underscores."""
    return df.select(*[F.col(n).alias(n.replace("`", "").replace(".", "_")) for n in _leaves(df.schema)])


def tab_delimit(df: DataFrame, name: str = "value") -> DataFrame:
    """One text column: all leaves joined by tabs, NULL as `null`."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(n).cast("string"), F.lit("null")) for n in _leaves(df.schema)]).alias(name))


def to_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def from_json(text: Column | str, schema: str) -> Column:
    """Fields of `schema`; unknown ones are ignored, and unparsable text gives NULLs."""
    return F.from_json(_c(text), schema)
