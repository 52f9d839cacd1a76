"""Code length under context-tree weighting, with counts from the whole corpus.

A byte is coded as eight binary decisions; each of the 255 places in that
binary tree has a context tree of its own over the bytes before, down to
`depth`. Every node mixes the Krichevsky-Trofimov estimate of its own counts
half and half with what its children together assign; given the corpus, the
share of each depth in a prediction is its posterior weight. Since that
depends on `depth` + 1 bytes alone, the corpus is gathered as counts of those
grams, each distinct gram is priced once, and texts are scored by look-up.

Texts are put into blocks, which are written once. A block sends its distinct
grams, sorted and coded by their differences, as one binary for each bucket of
the two latest context bytes; so a bucket holds whole subtrees from depth 2
down. What comes back to the block are the prices alone, in the order of its
grams, which it makes anew from its texts. A row for each gram would cost
several times its content. Depths 0 and 1 have at most 256 * 255 nodes and are
put together from one sum for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, LongType, StructField, StructType

from crawlspan.llm import text as T
from crawlspan.session import cut_lineage

DEPTH = 4
#: What a gram of eight bytes holds; contexts of this depth keep growing with the corpus.
DEEPEST = 7
#: Bytes of text in a block, and text for each bucket of grams.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 4 << 20
#: Grams whose trees are built at once, if their latest bytes aren't all the same.
TREE_GRAMS = 1 << 16
#: Prices travel as multiples of this part of a bit.
PARTS = 1 << 15

_HALF = float(np.log(0.5))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    r = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    for k in range(8):
        out -= np.log(x + k)
    return out


_FEW = np.arange(4096.0)
_HALVES, _WHOLES = log_gamma(_FEW + 0.5), log_gamma(_FEW + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log probability of any sequence with these counts, which are whole numbers; small ones are looked up."""
    n = zeros + ones
    few = n < len(_FEW)
    out = np.empty(n.shape)
    z, o = zeros[few].astype(np.int64), ones[few].astype(np.int64)
    out[few] = _HALVES[z] + _HALVES[o] - _WHOLES[z + o]
    z, o = zeros[~few], ones[~few]
    out[~few] = log_gamma(z + 0.5) + log_gamma(o + 0.5) - log_gamma(z + o + 1.0)
    return out - float(np.log(np.pi))


def grams(body: np.ndarray, offsets: np.ndarray, depth: int, step: int = 1 << 20) -> Iterator[np.ndarray]:
    """For each byte, the `depth` bytes before, the latest uppermost, and itself lowest, as one number; `step` bytes at a time.

    Before a text stand zero bytes.
    """
    for i in range(0, len(body), step):
        j = min(i + step, len(body))
        at = np.arange(i, j)
        where = at - offsets[np.searchsorted(offsets, at, "right") - 1]
        out = body[i:j].astype(np.uint64)
        for k in range(1, depth + 1):
            before = np.zeros(j - i, np.uint64)
            low = max(i, k)
            before[low - i :] = body[low - k : j - k]
            before[where < k] = 0
            out |= before << np.uint64(64 - 8 * k)
        yield out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, with the sums of their counts."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _distinct(body: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a block, sorted, with their counts."""
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for part in grams(body, offsets, depth):
        parts.append(np.unique(part, return_counts=True))
        if sum(len(k) for k, _ in parts[1:]) > max(1 << 22, len(parts[0][0])):
            parts = [_merged(parts)]
    return _merged(parts)


def _coded(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed planes of bytes."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + bytes([width]) + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _decoded(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    planes = np.frombuffer(pa.Codec("zstd").decompress(memoryview(blob)[9:], n * width), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.uint64)


def _sorted_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_decoded(blob), dtype=np.uint64)


def _by_bucket(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket of the two latest context bytes, where each bucket begins), from sorted grams."""
    of = (T.mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(buckets)).astype(np.uint16)[(key >> np.uint64(48)).astype(np.int64)]
    order = np.argsort(of, kind="stable")
    return order, np.searchsorted(of[order], np.arange(buckets + 1))


def _blocks(rows: DataFrame, kind: DataType) -> DataFrame:
    """block, ids, at, body: rows of (id, text) put together as they are scanned; NULL texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        number = (task.partitionId() if (task := TaskContext.get()) else 0) << 32

        def block() -> pa.RecordBatch:
            ids = pa.concat_arrays([h[0] for h in held])
            size = np.concatenate([np.diff(h[2]) for h in held])
            body = np.concatenate([h[1] for h in held])
            raw = len(body).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(body, asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([_coded(size)]), pa.array([raw])], ["block", "ids", "sizes", "body"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0), *T.flat(batch.column(1))))
            if sum(len(h[1]) for h in held) >= BLOCK_BYTES:
                yield block()
                held, number = [], number + 1
        if held:
            yield block()

    schema = StructType([StructField("block", LongType()), StructField("ids", ArrayType(kind)), StructField("sizes", BinaryType()), StructField("body", BinaryType())])
    return rows.mapInArrow(T.tidy(run), schema)


def _texts(sizes: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a block."""
    offsets = np.concatenate([[0], np.cumsum(_decoded(sizes).astype(np.int64))])
    n = int.from_bytes(body[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(memoryview(body)[8:], n), np.uint8) if n else np.zeros(0, np.uint8), offsets


_SENT = "bucket int, block long, keys binary, n binary"


def _gathered(blocks: DataFrame, depth: int, buckets: int, counts: bool = True, asks: bool = True) -> DataFrame:
    """What blocks send to buckets: their grams, with counts if those count, and with the block's number if it asks for prices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, body in zip(*(c.to_pylist() for c in batch.columns)):
                key, n = _distinct(*_texts(sizes, body), depth)
                order, at = _by_bucket(key, buckets)
                key, n = key[order], n[order]
                some = np.flatnonzero(np.diff(at))
                for i in range(0, len(some), 256):
                    part = some[i : i + 256]
                    keys = [_coded(np.diff(key[at[b] : at[b + 1]], prepend=np.uint64(0))) for b in part]
                    ns = [_coded(n[at[b] : at[b + 1]]) if counts else None for b in part]
                    yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([block if asks else None] * len(part), pa.int64()), pa.array(keys, pa.binary()), pa.array(ns, pa.binary())], ["bucket", "block", "keys", "n"])

    return blocks.select("block", "sizes", "body").mapInArrow(T.tidy(run), _SENT)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int | None, bytes]], np.ndarray, np.ndarray]]:
    """(bucket, what asks, its distinct grams, their counts) from sorted rows; at most twice the distinct grams are held uncoded."""
    now, asks, parts = None, [], []

    def whole() -> tuple[int, list[tuple[int | None, bytes]], np.ndarray, np.ndarray]:
        return now, asks, *_merged(parts)

    for batch in batches:
        for bucket, block, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                if now is not None:
                    yield whole()
                now, asks, parts = bucket, [], [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            if block is not None:
                asks.append((block, keys))
            key = _sorted_keys(keys)
            parts.append((key, np.zeros(len(key), np.int64) if n is None else _decoded(n).astype(np.int64)))
            if sum(len(k) for k, _ in parts[1:]) > max(1 << 20, len(parts[0][0])):
                parts = [_merged(parts)]
    if now is not None:
        yield whole()


def _pieces(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of sorted grams that hold whole subtrees, of about TREE_GRAMS or one subtree."""
    latest = key >> np.uint64(48)
    edge = np.append(np.flatnonzero(np.concatenate([[True], latest[1:] != latest[:-1]])), len(key)) if len(key) else np.zeros(1, np.int64)
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(edge, edge[i] + TREE_GRAMS, "right")) - 1)
        yield int(edge[i]), int(edge[j])
        i = j


class _Trees:
    """All context trees below the two latest context bytes, for distinct grams with counts.

    Grams come sorted by their context, latest byte first, then by the coded
    byte, so that the grams of a context are a run, and those of a node of its
    binary tree a run within that. The entries of a level, (context of d bytes,
    coded byte), come from those of the level above by one sort of the latter;
    all else are sums over runs and look-ups of parents.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        count = n.astype(float)
        self.key, self.maps, self.nodes = key, [], []
        below: list[np.ndarray] | None = None
        groups: list[np.ndarray] | None = None
        for d in range(depth, 1, -1):
            if d < depth:
                keep = np.uint64((1 << 64) - (1 << 8 * (8 - d)) | 0xFF)
                key, to = np.unique(key & keep, return_inverse=True)
                count = np.bincount(to, count, len(key))
                self.maps.append(to)
            byte, context = (key & np.uint64(0xFF)).astype(np.int64), key >> np.uint64(8)
            fresh = np.concatenate([[True], context[1:] != context[:-1]])
            level, before = [], groups
            groups, weights = [], []
            for k in range(8):
                prefix = byte >> (8 - k)
                new = fresh.copy()
                new[1:] |= prefix[1:] != prefix[:-1]
                first = np.flatnonzero(new)
                group = np.cumsum(new, dtype=np.int32) - 1
                total = np.add.reduceat(count, first)
                ones = np.add.reduceat(count * ((byte >> (7 - k)) & 1), first)
                own = log_kt(total - ones, ones)
                share, parent = None, None
                if before is None:
                    weighted = own
                else:
                    starts = self.nodes[-1][k][0]
                    parent = group[to[starts]]
                    own += _HALF
                    weighted = np.logaddexp(own, np.bincount(parent, below[k], len(first)) + _HALF)
                    share = np.exp(own - weighted)
                level.append((first, ones, total, share, parent))
                groups.append(group)
                weights.append(weighted)
            self.nodes.append(level)
            below = weights
        self.last, self.weighted, self.groups = key, below, groups

    def sums(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(latest byte, node, zeros, ones, log weighted probability) of the nodes of depth 2."""
        for k, (first, ones, total, _, _) in enumerate(self.nodes[-1]):
            key = self.last[first]
            node = (1 << k) | ((key & np.uint64(0xFF)).astype(np.int64) >> (8 - k))
            yield (key >> np.uint64(56)).astype(np.int64), node, total - ones, ones, self.weighted[k]

    def bits(self, kt1: np.ndarray, share1: np.ndarray, kt0: np.ndarray, share0: np.ndarray) -> np.ndarray:
        """What the last byte of each gram costs.

        kt, share: estimate of a zero and posterior weight of depth 1 by latest
        byte and node, and of depth 0 by node. The weight left over goes down
        the levels, from each node to the nodes below it.
        """
        cost = np.zeros(len(self.key))
        byte = (self.key & np.uint64(0xFF)).astype(np.int64)
        for k in range(8):
            key = self.last[self.nodes[-1][k][0]]
            latest, node = (key >> np.uint64(56)).astype(np.int64), (1 << k) | ((key & np.uint64(0xFF)).astype(np.int64) >> (8 - k))
            one = share0[node] * (1 - kt0[node])
            rest = 1 - share0[node]
            one += rest * share1[latest, node] * (1 - kt1[latest, node])
            rest = rest * (1 - share1[latest, node])
            for level in range(len(self.nodes) - 1, -1, -1):
                _, ones, total, share, parent = self.nodes[level][k]
                kt = (ones + 0.5) / (total + 1)
                if share is None:
                    one = one + rest * kt
                else:
                    one = one + rest * share * kt
                    rest = rest * (1 - share)
                    down = parent
                    one, rest = one[down], rest[down]
            first = self.nodes[0][k][0]
            p = np.repeat(one, np.diff(np.append(first, len(byte))))
            cost -= np.log2(np.where((byte >> (7 - k)) & 1 == 1, p, 1 - p))
        return cost


def _top(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kt of zero, share) at depth 1 by [latest byte, node] and at depth 0 by node, from the sums over depth 2."""
    shape = (256, 256)
    zeros, ones, below = (np.zeros(shape) for _ in range(3))
    where = (rows["byte"].to_numpy(), rows["node"].to_numpy())
    zeros[where], ones[where], below[where] = (rows[c].to_numpy() for c in ("zeros", "ones", "below"))
    own = log_kt(zeros, ones) + _HALF
    weighted = np.logaddexp(own, below + _HALF)
    weighted[(zeros + ones) == 0] = 0
    z0, o0 = zeros.sum(0), ones.sum(0)
    own0 = log_kt(z0, o0) + _HALF
    return (zeros + 0.5) / (zeros + ones + 1), np.exp(own - np.logaddexp(own, below + _HALF)), (z0 + 0.5) / (z0 + o0 + 1), np.exp(own0 - np.logaddexp(own0, weighted.sum(0) + _HALF)), weighted


def _prices(sent: DataFrame, depth: int) -> DataFrame:
    """block, bucket, bits: what the last byte of each gram costs after its other bytes, for each block that asks, in the order of its grams."""
    placed = cut_lineage(sent.repartition("bucket").sortWithinPartitions("bucket"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 256, 256))
        for _, _, key, n in _buckets(batches):
            for i, j in _pieces(key):
                for byte, node, zeros, ones, weighted in _Trees(key[i:j], n[i:j], depth).sums():
                    for k, c in enumerate((zeros, ones, weighted)):
                        np.add.at(total[k], (byte, node), c)
        some = np.nonzero(total.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some[0].astype(np.int32)), pa.array(some[1].astype(np.int32)), *(pa.array(total[k][some]) for k in range(3))], ["byte", "node", "zeros", "ones", "below"])

    top = placed.mapInArrow(T.tidy(sums), "byte int, node int, zeros double, ones double, below double")
    top = top.groupBy("byte", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    kt1, share1, kt0, share0, _ = _top(top.toArrow())  # at most 256 * 255 rows

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, asks, key, n in _buckets(batches):
            if not asks:
                continue
            price = np.empty(len(key), np.uint32)
            for i, j in _pieces(key):
                price[i:j] = np.rint(_Trees(key[i:j], n[i:j], depth).bits(kt1, share1, kt0, share0) * PARTS)
            for block, keys in asks:
                bits = _coded(price[np.searchsorted(key, _sorted_keys(keys))])
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([bits])], ["block", "bucket", "bits"])

    return placed.mapInArrow(T.tidy(cost), "block long, bucket int, bits binary")


def score(docs: DataFrame, corpus: DataFrame | None = None, text: str = "text", key: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """`key`, n_bytes, bits, bits_per_byte of every row of `docs`, under the counts of `corpus` (`docs` itself by default).

    Whole texts are gathered and scored, as UTF-8, long ones too; with `docs` as
    the corpus a text's own bytes are among the counts that price it. NULL and empty texts have 0
    bytes, 0 bits and NULL bits_per_byte; repeated rows count and are scored
    each; a NULL id stays NULL; other columns are ignored; empty tables give no
    rows, and with an empty corpus each bit costs one bit. Grams of `docs` that
    the corpus lacks are priced by the contexts that it has.
    """
    if not 2 <= depth <= DEEPEST:
        raise ValueError("depth must be from 2 to 7")
    kind = docs.schema[key].dataType
    blocks = cut_lineage(_blocks(docs.select(F.col(key), F.col(text)), kind))
    size = (docs if corpus is None else docs.select(text).unionByName(corpus.select(text))).agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = int(min(1 << 15, max(8, size // BUCKET_BYTES)))
    sent = _gathered(blocks, depth, buckets, counts=corpus is None)
    if corpus is not None:
        sent = sent.unionByName(_gathered(_blocks(corpus.select(F.lit(0), F.col(text)), IntegerType()), depth, buckets, asks=False))

    def scored(mine: pa.Table, price: pa.Table) -> pa.Table:
        ids, length, bits = [], [], []
        got = dict(zip(price["bucket"].to_pylist(), price["bits"].to_pylist())) if price.num_rows else {}
        for row in range(mine.num_rows):
            body, offsets = _texts(mine["sizes"][row].as_py(), mine["body"][row].as_py())
            grams_here, _ = _distinct(body, offsets, depth)
            order, at = _by_bucket(grams_here, buckets)
            parts = np.empty(len(grams_here), np.uint32)
            for b in np.flatnonzero(np.diff(at)):
                parts[order[at[b] : at[b + 1]]] = _decoded(got[int(b)])
            total = np.zeros(len(offsets) - 1, np.int64)
            done = 0
            for part in grams(body, offsets, depth):
                u, back = np.unique(part, return_inverse=True)
                sums = np.concatenate([[0], np.cumsum(parts[np.searchsorted(grams_here, u)][back], dtype=np.int64)])
                inside = np.clip(offsets - done, 0, len(part))
                total += np.diff(sums[inside])
                done += len(part)
            ids.append(mine["ids"].chunk(0).slice(row, 1).flatten() if mine["ids"].num_chunks == 1 else mine["ids"].combine_chunks().slice(row, 1).flatten())
            length.append(np.diff(offsets))
            bits.append(total / PARTS)
        return pa.table([pa.concat_arrays(ids), pa.array(np.concatenate(length)), pa.array(np.concatenate(bits))], [key, "n_bytes", "bits"])

    schema = StructType([StructField(key, kind), StructField("n_bytes", LongType()), StructField("bits", DoubleType())])
    out = blocks.groupBy("block").cogroup(_prices(sent, depth).groupBy("block")).applyInArrow(scored, schema)
    return out.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")))
