"""Concatenate and cut: the encoded corpus as one stream, cut into fixed windows.

First pass: each partition encodes its documents into chunks of consecutive
tokens, kept in the shared folder with their offset in the partition, and the
partitions' token totals are summed up to global offsets. Second pass: each
chunk, now knowing where it stands, yields the windows that lie wholly inside
it. The window at either edge of a chunk is put together from short head and
tail blobs that the first pass stored apart, so that no token is shuffled but
those of edge windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from crawlspan.llm import pieces
from crawlspan.llm import text as T
from crawlspan.session import shared_dir

_CHUNK = "part int, at long, n long, tokens binary, head binary, tail binary, sizes array<int>"
_WINDOW = "window_id long, pos int, tokens array<int>, doc_starts array<long>, starts array<int>, lengths array<int>"


def _chunks(width: int, path: str, eos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        kind = np.uint16 if pieces.model(path).size <= 1 << 16 else np.uint32
        for batch, ids, offsets in pieces.encoded(batches, path):
            stream = np.insert(ids, offsets[1:], eos).astype(kind)
            raw = [stream.tobytes(), stream[:width].tobytes(), stream[-width:].tobytes()]
            sizes = np.diff(offsets) + 1
            row = [[part], [at], [len(stream)], *([x] for x in raw)]
            columns = [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            one = pa.array([0, len(sizes)], pa.int32())
            columns += [pa.ListArray.from_arrays(one, pa.array(sizes, pa.int32())), pa.ListArray.from_arrays(one, batch.column(0))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "at", "n", "tokens", "head", "tail", "sizes", "keys"])
            at += len(stream)

    return run


def _rows(stream: np.ndarray, low: int, high: int, keys: np.ndarray, sizes: np.ndarray, width: int, base: int) -> pa.RecordBatch:
    """Window rows of a chunk's tokens low..high, which `stream` holds. base: the chunk's global offset."""
    ends = np.cumsum(sizes.astype(np.int64))
    begins = ends - sizes
    g = base + low
    edges = np.arange(g // width * width + width, base + high, width) - base
    cuts = np.concatenate([[low], edges]).astype(np.int64)
    inner = begins[(begins > low) & (begins < high)]
    seg = np.unique(np.concatenate([cuts, inner]))
    seg_end = np.append(seg[1:], high)
    doc = np.searchsorted(ends, seg, "right")
    at_window = np.append(np.searchsorted(seg, cuts), len(seg)).astype(np.int32)
    ints = pa.int32()
    lists = lambda x: pa.ListArray.from_arrays(pa.array(at_window), x)
    columns = [
        pa.array((base + cuts) // width, pa.int64()),
        pa.array((base + cuts) % width, ints),
        pa.ListArray.from_arrays(pa.array(np.append(cuts - low, high - low).astype(np.int32)), pa.array(stream.astype(np.int32))),
        lists(pa.array(seg - begins[doc], pa.int64())),
        lists(pa.array((base + seg) % width, ints)),
        lists(pa.array(seg_end - seg, ints)),
        lists(keys.take(pa.array(doc))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["window_id", "pos", "tokens", "doc_starts", "starts", "lengths", "doc_ids"])


def _cut(width: int, bases: np.ndarray, kind: type, edges: bool):
    """Over chunk rows: the whole windows inside each chunk, or what is left of it at its two edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                part, at, n = (batch.column(k)[r].as_py() for k in range(3))
                base = int(bases[part]) + at
                first, last = min(-base % width, n), (base + n) // width * width - base
                keys = batch.column("keys")[r].values
                sizes = batch.column("sizes")[r].values.to_numpy()
                read = lambda c: np.frombuffer(batch.column(c)[r].as_buffer(), kind)
                if not edges:
                    if last > first:
                        yield _rows(read("tokens")[first:last], first, last, keys, sizes, width, base)
                    continue
                if first:
                    yield _rows(read("head")[:first], 0, first, keys, sizes, width, base)
                if n > max(last, first):
                    rest = n - max(last, first)
                    yield _rows(read("tail")[-rest:], n - rest, n, keys, sizes, width, base)

    return run


def pack(docs: DataFrame, width: int = 2048, text: str = "text", key: str = "doc_id", path: str = pieces.MODEL, eos: int = 2) -> DataFrame:
    """Windows of `width` tokens: window_id, tokens, n_tokens, doc_ids, doc_starts, starts, lengths.

    The stream is every document's tokens and `eos`, in the order in which the
    table is scanned. The four lists are the boundary records of a window: piece
    k is `lengths[k]` tokens of document `doc_ids[k]` from its token
    `doc_starts[k]`, at `starts[k]` in the window. Only the last window may be
    shorter. No token is lost or repeated.

    NULL and empty texts give a lone `eos`; a document longer than a window
    spans several; repeated rows and ids are packed each; a NULL id stays NULL
    in its records; ids keep their type; other columns are ignored; an empty
    table gives no windows. Rereading the kept chunks, not re-encoding, is what a
    lost executor costs; they stay in `packing-*` of the shared folder, since the
    result reads them.
    """
    spark = docs.sparkSession
    place = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    ids = ArrayType(docs.schema[key].dataType)
    stored, window = T.schema(_CHUNK, keys=ids), T.schema(_WINDOW, doc_ids=ids)
    source.mapInArrow(T.tidy(_chunks(width, path, eos)), stored).write.parquet(place)
    chunks = spark.read.schema(stored).parquet(place)
    totals = {r.part: r.n for r in chunks.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    parts = max(totals, default=-1) + 1
    sizes = np.array([totals.get(p, 0) for p in range(parts)], np.int64)
    bases = np.concatenate([[0], np.cumsum(sizes)])[:-1] if parts else sizes
    kind = np.uint16 if pieces.model(path).size <= 1 << 16 else np.uint32
    whole = chunks.select("part", "at", "n", "tokens", "keys", "sizes").mapInArrow(T.tidy(_cut(width, bases, kind, False)), window)
    edge = chunks.select("part", "at", "n", "head", "tail", "keys", "sizes").mapInArrow(T.tidy(_cut(width, bases, kind, True)), window)
    lists = ["tokens", "doc_ids", "doc_starts", "starts", "lengths"]
    parts_of = F.sort_array(F.collect_list(F.struct("pos", *lists)))
    merged = edge.groupBy("window_id").agg(parts_of.alias("p")).select("window_id", *[F.flatten(F.col(f"p.{c}")).alias(c) for c in lists])
    return whole.select("window_id", *lists).unionByName(merged).select("window_id", "tokens", F.size("tokens").alias("n_tokens"), *lists[1:])
