"""Flat numpy forms of Arrow text columns, shared by the operators of this subpackage.

Texts become one byte array with offsets, so that words are found and hashed
for a whole slice of a batch at once. A NULL text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes that belong to words: ASCII letters and digits, and all bytes of other scripts.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column: row i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    k, p = 1, base
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * p
        p, k = p * p, 2 * k
    return out[:n]


_cache: dict[str, np.ndarray] = {"p": np.ones(0, np.uint64), "q": np.ones(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept between calls up to 16 MB."""
    if len(_cache["p"]) < n:
        with np.errstate(over="ignore"):
            p, q = _powers(n, _BASE), _powers(n, _BASE_INV)
        if n > 1 << 20:
            return p, q
        _cache["p"], _cache["q"] = p, q
    return _cache["p"][:n], _cache["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none crosses from one row into the next."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = WORD[body]
    edge = np.empty(len(body) + 1, bool)
    edge[0], edge[-1] = w[0], w[-1]
    np.not_equal(w[1:], w[:-1], out=edge[1:-1])
    inner = offsets[(offsets > 0) & (offsets < len(body))]
    inner = inner[w[inner] & w[inner - 1]]
    bounds = np.flatnonzero(edge)
    if len(inner):
        bounds = np.sort(np.concatenate([bounds, np.repeat(np.unique(inner), 2)]))
    return bounds[::2], bounds[1::2]


def span_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever the span stands."""
    p, q = powers(len(body))
    with np.errstate(over="ignore"):
        s = np.empty(len(body) + 1, np.uint64)
        s[0] = 0
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * p, out=s[1:])
        return mix((s[ends] - s[starts]) * q[np.minimum(starts, max(len(q) - 1, 0))] if len(starts) else s[:0])


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row each position falls in."""
    return np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words i..i+n-1 for each i that has them."""
    m = max(0, len(words) - n + 1)
    with np.errstate(over="ignore"):
        h = words[:m].copy()
        for k in range(1, n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    return mix(h)


def codepoints(raw: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Code points of valid UTF-8, given where characters begin."""
    b0 = raw[lead].astype(np.int64)
    code = b0.copy()
    for size, low, bits in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        k = np.flatnonzero(b0 >= low if size == 4 else (b0 >= low) & (b0 < low + (0x20 if size == 2 else 0x10)))
        if len(k):
            c = b0[k] & bits
            for j in range(1, size):
                c = (c << 6) | (raw[lead[k] + j] & 0x3F)
            code[k] = c
    return code


def schema(ddl: str, **first: DataType) -> StructType:
    """The columns of `ddl`, then those of given types, whose names and inner names may hold any character."""
    return StructType([*StructType.fromDDL(ddl).fields, *(StructField(name, kind) for name, kind in first.items())])


def tidy(run):
    """`run` over batches, after which the worker's freed memory goes back to the system: workers live on into later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
                trim(0)

    return tidied


def keyed(batches: Iterator[pa.RecordBatch], limit: int = 1 << 24) -> Iterator[pa.Table]:
    """Tables of whole keys (first column, sorted), of about `limit` bytes or one key."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
