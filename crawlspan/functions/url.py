"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^(?i)(https?|ftp)://(?:[^/?#@]*@)?([^/:?#]*)"
_SCHEME = r"^(?i)(https?|ftp|file|mailto|jar):"


def host(url: Column | str) -> Column:
    """Host of a URL: NULL if it is malformed, '' if its scheme has no host."""
    u = F.col(url) if isinstance(url, str) else url
    return F.when(u.rlike(_HOST), F.regexp_extract(u, _HOST, 2)).when(u.rlike(_SCHEME), F.lit(""))


def extract_domain(url: Column | str, source: Column | str | None = None) -> Column:
    """Host of `url`; where that is malformed, the host of `source`; NULL url stays NULL."""
    u = F.col(url) if isinstance(url, str) else url
    if source is None:
        return host(u)
    return F.when(u.isNotNull(), F.coalesce(host(u), host(source)))


def remove_www(name: Column | str) -> Column:
    """Without leading white space and `www.`; other names unchanged."""
    return F.regexp_replace(name, r"^\s*www\.", "")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


_PARTS = r"^(?i)(?:https?|ftp)://(?:[^/?#@]*@)?([^/:?#]*)(?::(\d+))?([^#]*)"


def reverse_hostname(name: Column | str) -> Column:
    """Labels of a host in reverse; a `:port` stays at the end. Its own inverse."""
    h = _c(name)
    labels = F.array_join(F.reverse(F.split(F.regexp_extract(h, "^([^:]*)", 1), "[.]")), ".")
    return F.concat(labels, F.regexp_extract(h, "(:.*)?$", 0))


def url_to_key(url: Column | str) -> Column:
    """Reversed host, explicit port, path and query; NULL for a malformed URL. Scheme and fragment are lost."""
    u = _c(url)
    port = F.regexp_extract(u, _PARTS, 2)
    return F.when(u.rlike(_PARTS), F.concat(reverse_hostname(F.regexp_extract(u, _PARTS, 1)), F.when(port != "", F.concat(F.lit(":"), port)).otherwise(""), F.regexp_extract(u, _PARTS, 3)))


def key_to_url(key: Column | str) -> Column:
    """The http:// URL of a key; a key without a slash gives the bare host."""
    k = _c(key)
    name = reverse_hostname(key_domain(k))
    return F.when(F.locate("/", k) > 0, F.concat(F.lit("http://"), name, F.regexp_extract(k, "(/.*)$", 1))).otherwise(name)


def key_domain(key: Column | str) -> Column:
    """What stands before the first slash."""
    return F.split_part(_c(key), F.lit("/"), F.lit(1))


def file_type(url: Column | str) -> Column:
    """Suffix behind the last dot of the last path segment; '' after a slash, without a dot, if longer than 8, or if a lone digit."""
    last = F.element_at(F.split(_c(url), "/"), -1)
    suffix = F.element_at(F.split(last, "[.]"), -1)
    none = (F.locate(".", last) == 0) | (F.length(suffix) > 8) | suffix.rlike("^[0-9]$")
    return F.when(none, F.lit("")).otherwise(suffix)
