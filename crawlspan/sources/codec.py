"""Streaming ARC and WARC records, plain or gzipped member by member; no Spark here."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import BinaryIO

_ARC_LINE = re.compile(rb"^(\S+) (\S+) (\d{14}|\d{8,17}) (.*?) (-?\d+)\s*$")
_WARC_LINE = re.compile(rb"^WARC/\d")


@dataclass
class Record:
    """One record as its file has it. ARC: type None; WARC: mime is that of the HTTP response, if any."""

    format: str
    record_type: str | None
    url: str | None
    ip: str | None
    date: str | None
    mime: str | None
    length: int
    content: bytes
    headers: dict[str, str] = field(default_factory=dict)


class Malformed(ValueError):
    """What follows can't be read as records."""


class _Gunzip(io.RawIOBase):
    """Members of a gzip stream, one after another; what a cut or broken one still holds comes before the end."""

    def __init__(self, f: BinaryIO):
        self.f, self.member, self.rest = f, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while True:
            data = self.rest or self.f.read(1 << 16)
            self.rest = b""
            if not data and (self.member is None or not self.member.unconsumed_tail):
                return 0
            if self.member is None:
                data = data.lstrip(b"\0")
                if not data:
                    continue
                self.member = zlib.decompressobj(31)
            try:
                out = self.member.decompress(self.member.unconsumed_tail + data, len(b))
            except zlib.error:
                self.f, self.member = io.BytesIO(), None
                return 0
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, None
            if out:
                b[: len(out)] = out
                return len(out)


def opened(raw: BinaryIO) -> BinaryIO:
    """A buffered stream of the bytes, unpacked if they are gzip (of any number of members)."""
    buffered = raw if isinstance(raw, io.BufferedReader) else io.BufferedReader(raw, 1 << 20)
    return io.BufferedReader(_Gunzip(buffered), 1 << 20) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered


def _line(f: BinaryIO) -> bytes:
    try:
        return f.readline()
    except (EOFError, OSError, zlib.error) as e:
        raise Malformed(str(e)) from e


def _block(f: BinaryIO, n: int) -> bytes:
    """n bytes; none for a negative length."""
    if n <= 0:
        return b""
    try:
        data = f.read(n)
    except (EOFError, OSError, zlib.error) as e:
        raise Malformed(str(e)) from e
    if len(data) < n:
        raise Malformed(f"a record of {n} bytes ends after {len(data)}")
    return data


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def http_body(content: bytes) -> bytes:
    """What follows the header of an HTTP response; other content unchanged."""
    at = content.find(b"\r\n\r\n")
    return content[at + 4 :] if content.startswith(b"HTTP/") and at >= 0 else content


_MIME = re.compile(rb"(?i)Content-Type: ([^\s]+)")


def response_mime(content: bytes) -> str | None:
    m = _MIME.search(content)
    return _text(m[1]).removesuffix(";") if m else None


def instant(date: str | None) -> datetime | None:
    """A 14-digit or ISO-8601 date as UTC; None for anything else."""
    if not date:
        return None
    try:
        if date.isdigit():
            return datetime.strptime(date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)
        return datetime.fromisoformat(date.replace("Z", "+00:00")).astimezone(timezone.utc)
    except ValueError:
        return None


def read_arc(f: BinaryIO) -> Iterator[Record]:
    """Every record, the version block first. Content keeps its HTTP header."""
    while True:
        line = _line(f)
        if not line:
            return
        if not line.strip():
            continue
        m = _ARC_LINE.match(line)
        if not m:
            raise Malformed(f"no ARC record line: {line[:80]!r}")
        n = int(m[5])
        yield Record("ARC", None, _text(m[1]), _text(m[2]), _text(m[3]), _text(m[4]) or None, n, _block(f, n))


def read_warc(f: BinaryIO) -> Iterator[Record]:
    """Every record of any type."""
    while True:
        line = _line(f)
        if not line:
            return
        if not line.strip():
            continue
        if not _WARC_LINE.match(line):
            raise Malformed(f"no WARC version line: {line[:80]!r}")
        headers: dict[str, str] = {}
        last = ""
        while (line := _line(f)).strip():
            text = _text(line.rstrip(b"\r\n"))
            if text[:1] in " \t" and last:
                headers[last] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                last = name.strip().lower()
                headers[last] = value.strip()
        if not line:
            raise Malformed("the file ends within a header")
        try:
            n = int(headers.get("content-length", "0"))
        except ValueError as e:
            raise Malformed(str(e)) from e
        content = _block(f, n)
        kind = headers.get("warc-type")
        url = headers.get("warc-target-uri")
        mime = response_mime(content) if kind == "response" else None
        yield Record("WARC", kind, url.strip("<>") if url else None, headers.get("warc-ip-address"), headers.get("warc-date"), mime, n, content, headers)


def sniff(f: BinaryIO) -> str:
    """ARC or WARC, by the first bytes."""
    return "WARC" if f.peek(5)[:5] == b"WARC/" else "ARC"


def read(raw: BinaryIO, kind: str | None = None, mode: str = "PERMISSIVE") -> Iterator[Record]:
    """Records of a file. kind: ARC, WARC or None to look.

    mode: PERMISSIVE ends the file at the first malformed record, DROPMALFORMED
    looks for the next WARC record instead, FAILFAST raises.
    """
    f = opened(raw)
    try:
        kind = kind or sniff(f)
        while True:
            try:
                yield from (read_warc if kind == "WARC" else read_arc)(f)
                return
            except Malformed:
                if mode == "FAILFAST":
                    raise
                if mode == "PERMISSIVE" or kind == "ARC":
                    return
                while (head := f.peek(5)[:5]) != b"WARC/":
                    if not head:
                        return
                    f.readline()
    except (EOFError, OSError, zlib.error) as e:
        if mode == "FAILFAST":
            raise Malformed(str(e)) from e


def arc_bytes(r: Record) -> bytes:
    return f"{r.url} {r.ip or '0.0.0.0'} {r.date} {r.mime or 'no-type'} {len(r.content)}\n".encode() + r.content + b"\n"


def warc_bytes(r: Record) -> bytes:
    names = dict(r.headers)
    for name, value in (("warc-type", r.record_type), ("warc-target-uri", r.url), ("warc-date", r.date), ("content-length", str(len(r.content)))):
        if value is not None:
            names[name] = value
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in names.items()).encode() + b"\r\n" + r.content + b"\r\n\r\n"


def to_bytes(r: Record) -> bytes:
    return warc_bytes(r) if r.format == "WARC" else arc_bytes(r)


def from_bytes(data: bytes, kind: str | None = None) -> Record:
    """The first record in the bytes."""
    return next(read(io.BufferedReader(io.BytesIO(data)), kind, "FAILFAST"))


def write(path: str, records: list[Record], packed: bool = True) -> None:
    """A file of the records, each a gzip member of its own if `packed`."""
    with open(path, "wb") as f:
        for r in records:
            f.write(gzip.compress(to_bytes(r)) if packed else to_bytes(r))
