"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a slice are one flat symbol array. Each round looks up
the rank of every adjacent pair, takes the minimum of each word, merges its
leftmost occurrences in all words at once, compacts, and drops words in which
no pair is left. Words met before come from a cache, so the rounds only see
new ones.

Merging many occurrences at once equals the one-at-a-time order of a priority
queue only where the merged piece can't at once join a neighbour at the same
or a better rank. Pieces that can are `single`: of those, a round merges the
leftmost occurrence of each word alone.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crawlspan.llm import text as T

#: Where the vocabulary lies unless a caller names another file.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Bytes of text that are encoded at once; a longer text is one slice.
SLICE = 1 << 19
#: Words beyond this many bytes are told apart by a cryptographic hash: long texts that collide under a polynomial one can be made up.
LONG_WORD = 255

_NONE = np.int32(1 << 30)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: (number, bytes or integer)."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, data[i : i + n]
            i += n


class PieceModel:
    """A BPE vocabulary with byte fallback, as lookup tables."""

    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds = [], [], []
        norm = {3: 1, 4: 1, 5: 1}
        trainer = {}
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                kinds.append(x.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm |= dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or norm.get(2) or not norm[3] or norm[4] or 4 in kinds:
            raise ValueError(f"{path}: needs a BPE model with byte fallback, a dummy prefix and no other normalisation")
        self.pieces, self.size = pieces, len(pieces)
        self.byte_id = np.zeros(256, np.int64)
        ids: dict[str, int] = {}
        for k, (p, kind) in enumerate(zip(pieces, kinds)):
            if kind == 6:
                self.byte_id[int(p[3:5], 16)] = k
            elif kind == 1:
                ids[p] = k
        private = {c: len(pieces) + k for k, c in enumerate(sorted({c for p in ids for c in p} - set(ids)))}
        symbols = ids | private
        #: Symbol of each character: a piece, else beyond every symbol that merges.
        self.first_unknown = len(pieces) + len(private)
        self.symbol = np.full(0x110000, -1, np.int32)
        for c, k in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = k
        self.known = np.zeros(self.first_unknown + 1, bool)
        self.known[list(ids.values())] = True
        order = {s: k for k, s in enumerate(sorted({scores[k] for k in ids.values()}, reverse=True))}
        triples = [(symbols[p[:i]], symbols[p[i:]], k) for p, k in ids.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
        left, right, out = (np.array(x, np.int64) for x in zip(*triples))
        rank = np.array([order.get(x, 0) for x in scores], np.int32)
        self.rank_of_join = np.append(rank, _NONE)  # joins of -1 take the last entry
        best = np.full(self.first_unknown + 1, _NONE)
        np.minimum.at(best, left, rank[out])
        np.minimum.at(best, right, rank[out])
        self.single = np.zeros(self.first_unknown + 1, bool)
        self.single[: self.size] = best[: self.size] <= rank
        self._hash(left * (self.first_unknown + 1) + right, out)

        #: ASCII characters that no piece joins to anything: words end at them.
        joined = {c for p in ids if len(p) > 1 for c in p}
        self.alone = np.array([chr(b) not in joined and b != 32 if b < 128 else False for b in range(256)])
        texts = [bytes([int(p[3:5], 16)]) if kind == 6 else p.replace("▁", " ").encode() if kind == 1 else b"" for p, kind in zip(pieces, kinds)]
        self.out_at = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        self.out_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self._forget()

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table, filled by rounds of linear probing."""
        self.bits = int(np.ceil(np.log2(len(keys) * 4)))
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that joins each pair, or -1."""
        keys = left.astype(np.int64) * (self.first_unknown + 1) + right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    # -- encoding ---------------------------------------------------------

    def encode_words(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words given as spans of UTF-8 bytes in which a space is a word's mark."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        raw = _gather(body, starts, ends - starts)
        word_at = np.concatenate([[0], np.cumsum(ends - starts)])
        at = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)  # where each symbol begins in raw
        code = T.codepoints(raw, at)
        code[code == 32] = 0x2581
        sym = self.symbol[code]
        sym[sym < 0] = self.first_unknown
        mark = np.zeros(len(raw), np.int32)
        mark[word_at[:-1]] = 1
        word = np.cumsum(mark, dtype=np.int32)[at] - 1
        joins = np.full(len(sym), -1, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        joins[inner] = self.pair(sym[inner], sym[inner + 1])
        done = np.full(len(raw), -1, np.int32)  # finished symbols by where they begin
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            ranks = self.rank_of_join[joins]
            lengths = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(ranks, first)
            over = least >= _NONE
            if over.any():
                gone = np.repeat(over, lengths)
                done[at[gone]] = sym[gone]
                keep = ~gone
                sym, word, at, joins, ranks = sym[keep], word[keep], at[keep], joins[keep], ranks[keep]
                least, lengths = least[~over], lengths[~over]
                if not len(sym):
                    break
            hit = _leftmost(np.flatnonzero(ranks == np.repeat(least, lengths)))
            alone = self.single[joins[hit]]
            if alone.any():
                # of a single piece, only the first hit of its word
                head = np.concatenate([[True], np.diff(word[hit]) != 0])
                at_head = np.flatnonzero(head)
                bad = np.maximum.reduceat(alone, at_head)
                hit = hit[head | ~np.repeat(bad, np.diff(np.append(at_head, len(hit))))]
            sym[hit] = joins[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, at, joins = sym[keep], word[keep], at[keep], joins[keep]
            hit = hit - np.arange(len(hit))
            stale = np.concatenate([hit, hit[hit > 0] - 1])
            last = stale == len(sym) - 1
            joins[stale[last]] = -1
            stale = stale[~last]
            joins[stale] = np.where(word[stale] == word[stale + 1], self.pair(sym[stale], sym[stale + 1]), -1)
        at = np.flatnonzero(done >= 0)
        sym = done[at]
        word = np.cumsum(mark, dtype=np.int32)[at] - 1
        lost = ~self.known[sym]
        if lost.any():
            size = np.diff(np.append(at, len(raw)))
            reps = np.where(lost, size, 1)
            where = np.repeat(at, reps) + _within(reps)
            flag = np.repeat(lost, reps)
            word = np.repeat(word, reps)
            sym = np.where(flag, self.byte_id[raw[where]], np.repeat(sym, reps))
        return sym.astype(np.int32), np.searchsorted(word, np.arange(n + 1))

    def _forget(self) -> None:
        self.seen = np.zeros(0, np.uint64)
        self.seen_at, self.seen_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def encode(self, body: np.ndarray, offsets: np.ndarray, counts_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids, offsets) of the rows of a flat text column; ids is None if only counts are asked for."""
        n = len(offsets) - 1
        filled = np.diff(offsets) > 0
        body = np.insert(body, offsets[:-1][filled], 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        if not len(body):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        space, alone = body == 32, self.alone[body]
        cut = np.empty(len(body), bool)
        cut[0] = True
        cut[1:] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
        cut[offsets[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(body))
        keys = T.span_hashes(body, starts, ends)
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            keys[k] = int.from_bytes(hashlib.blake2b(body[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.seen) > 400_000:
            self._forget()
        spot = np.searchsorted(self.seen, distinct)
        fresh = np.ones(len(distinct), bool)
        if len(self.seen):
            inside = spot < len(self.seen)
            fresh[inside] = self.seen[spot[inside]] != distinct[inside]
        if fresh.any():
            w = where[fresh]
            ids, at = self.encode_words(body, starts[w], ends[w])
            put = spot[fresh]
            self.seen = np.insert(self.seen, put, distinct[fresh])
            self.seen_at = np.insert(self.seen_at, put, at[:-1] + len(self.pool))
            self.seen_n = np.insert(self.seen_n, put, np.diff(at))
            self.pool = np.concatenate([self.pool, ids])
            spot = np.searchsorted(self.seen, distinct)
        sizes = self.seen_n[spot][back]
        total = np.concatenate([[0], np.cumsum(sizes)])
        rows = total[np.searchsorted(starts, offsets)]
        return None if counts_only else _gather(self.pool, self.seen_at[spot][back], sizes), rows

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of each row of ids. Bytes that are no UTF-8 become U+FFFD."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        sizes = np.diff(self.out_at)[ids]
        body = _gather(self.out_bytes, self.out_at[ids], sizes)
        at = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        lead = at[:-1][at[1:] > at[:-1]]
        lead = lead[body[lead] == 32]
        shift = np.searchsorted(lead, at)
        body = np.delete(body, lead)
        at = at - shift
        out = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            raw = bytes(body)
            out = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])], pa.large_string())
        return out


def _within(reps: np.ndarray) -> np.ndarray:
    """0..reps[0]-1, 0..reps[1]-1, ..."""
    total = np.cumsum(reps)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - reps, reps)


def _gather(pool: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[at[0]:at[0] + sizes[0]], pool[at[1]:...], ... in one array."""
    return pool[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def _leftmost(hit: np.ndarray) -> np.ndarray:
    """Of sorted positions of pairs, those kept when overlapping ones are taken from the left."""
    if not len(hit):
        return hit
    run = np.concatenate([[True], np.diff(hit) != 1])
    start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
    return hit[(np.arange(len(hit)) - start) % 2 == 0]


@lru_cache(2)
def model(path: str = MODEL) -> PieceModel:
    """The vocabulary, loaded once in each worker."""
    return PieceModel(path)


def _plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat text with U+2581 turned into spaces, as the format has it."""
    import pyarrow.compute as pc

    if pc.any(pc.match_substring(column, "▁")).as_py():
        column = pc.replace_substring(column, "▁", " ")
    return T.flat(column)


def encoded(batches: Iterator[pa.RecordBatch], path: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For slices of batches (id, text): the slice, ids and offsets."""
    m = model(path)
    for batch in batches:
        body, offsets = _plain(batch.column(1))
        for i, j in T.slices(offsets, limit):
            ids, at = m.encode(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch.slice(i, j - i), ids, at


def token_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """`key`, n_tokens of each row, by the rounds above without building the ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            body, offsets = _plain(batch.column(1))
            for i, j in T.slices(offsets, SLICE):
                _, at = m.encode(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], counts_only=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64())], [key, "n_tokens"])

    return docs.select(key, text).mapInArrow(T.tidy(run), f"`{key}` {kind}, n_tokens long")


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """`key`, tokens (ARRAY<INT>), n_tokens for every row; equal to the public library's ids.

    Narrow: no shuffle, one Arrow pass, memory bounded by slices of half a MB (a
    longer text is one slice). Repeated rows and ids are encoded each on its
    own; NULL and empty texts have no tokens; a NULL id stays NULL; further
    columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, at in encoded(batches, path):
            tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(np.diff(at), pa.int64())], [key, "tokens", "n_tokens"])

    return docs.select(key, text).mapInArrow(T.tidy(run), f"`{key}` {kind}, tokens array<int>, n_tokens long")


def decode(rows: DataFrame, tokens: str = "tokens", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """`key`, text of each row of ids: the exact inverse of `encode` for texts without U+2581.

    NULL and empty lists decode to ''. A NULL or unknown id raises.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            lists = lists.cast(pa.large_list(pa.int32()))
            values, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), m.decode(values, at - at[0]).cast(pa.string())], [key, "text"])

    return rows.select(key, tokens).mapInArrow(T.tidy(run), f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """`encode` with a column `exact`: decoding gives the text back. Handles rows as `encode` does."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        m = model(path)
        for batch, ids, at in encoded(batches, path):
            tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
            same = pc.equal(m.decode(ids, at), batch.column(1).fill_null("").cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, pa.array(np.diff(at), pa.int64()), same], [key, "tokens", "n_tokens", "exact"])

    return docs.select(key, text).mapInArrow(T.tidy(run), f"`{key}` {kind}, tokens array<int>, n_tokens long, exact boolean")
