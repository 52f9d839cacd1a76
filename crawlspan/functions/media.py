"""Image sizes and MIME types from the bytes themselves."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def size_of(data: bytes | None) -> tuple[int, int]:
    """(width, height) of a PNG, GIF, JPEG or BMP by its header; (0, 0) for anything else."""
    d = data or b""
    try:
        if d[:8] == b"\x89PNG\r\n\x1a\n" and d[12:16] == b"IHDR":
            return struct.unpack(">II", d[16:24])
        if d[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", d[6:10])
        if d[:2] == b"BM":
            w, h = struct.unpack("<ii", d[18:26])
            return w, abs(h)
        if d[:2] == b"\xff\xd8":
            i = 2
            while i + 9 < len(d):
                if d[i] != 0xFF:
                    i += 1
                    continue
                kind = d[i + 1]
                if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
                    i += 1 if kind == 0xFF else 2
                    continue
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", d[i + 5 : i + 9])
                    return w, h
                i += 2 + struct.unpack(">H", d[i + 2 : i + 4])[0]
    except struct.error:
        pass
    return 0, 0


_SIZE = pa.struct([("width", pa.int32()), ("height", pa.int32())])


def image_size(content: Column | str) -> Column:
    """STRUCT<width, height>."""

    @F.arrow_udf("struct<width:int,height:int>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("width", "height"), size_of(x))) for x in column.to_pylist()], _SIZE)

    return run(F.col(content) if isinstance(content, str) else content)


#: (offset, magic as hex, type), the first that fits counts.
MAGIC = (
    (1, "89504E470D0A1A0A", "image/png"),
    (1, "474946383761", "image/gif"),
    (1, "474946383961", "image/gif"),
    (1, "FFD8FF", "image/jpeg"),
    (1, "424D", "image/bmp"),
    (9, "57454250", "image/webp"),
    (1, "49492A00", "image/tiff"),
    (1, "4D4D002A", "image/tiff"),
    (1, "00000100", "image/vnd.microsoft.icon"),
    (1, "255044462D", "application/pdf"),
    (1, "504B0304", "application/zip"),
    (1, "1F8B", "application/gzip"),
    (1, "377ABCAF271C", "application/x-7z-compressed"),
    (1, "52617221", "application/x-rar-compressed"),
    (1, "D0CF11E0A1B11AE1", "application/x-ole-storage"),
    (1, "465753", "application/x-shockwave-flash"),
    (1, "435753", "application/x-shockwave-flash"),
    (1, "494433", "audio/mpeg"),
    (1, "4F676753", "application/ogg"),
    (5, "66747970", "video/mp4"),
    (1, "1A45DFA3", "video/x-matroska"),
)


def detect_mime(content: Column | str) -> Column:
    """MIME type by magic bytes, then by markup; 'N/A' for empty content, text/plain or application/octet-stream else."""
    c = (F.col(content) if isinstance(content, str) else content).cast("binary")
    out = F.when(c.isNull() | (F.octet_length(c) == 0), F.lit("N/A"))
    for at, magic, kind in MAGIC:
        out = out.when(F.hex(F.substring(c, at, len(magic) // 2)) == magic, F.lit(kind))
    head = F.lower(F.ltrim(F.make_valid_utf8(F.substring(c, 1, 1024).cast("string"))))
    feed = head.rlike(r"^(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)?<rss\b")
    html = head.rlike(r"^(<\?xml[^>]*>\s*)?(<!--(?s:.*?)-->\s*)*<(!doctype html|html|head|body|title|script|table|h1)\b")
    binary = F.hex(F.substring(c, 1, 512)).rlike("^(?:..)*?0[0-8]")
    return out.when(feed, "application/rss+xml").when(html & head.contains("xhtml"), "application/xhtml+xml").when(html, "text/html").when(head.startswith("<?xml"), "application/xml").when(binary, "application/octet-stream").otherwise("text/plain")
