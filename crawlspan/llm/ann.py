"""Approximate nearest neighbours over balanced posting lists.

Vectors are spread over lists around centroids. Centroids come from Lloyd
rounds over a bounded sample of the vectors, after each of which long lists are
split and short ones dropped; every vector is then put into its list, one near
a boundary into several. Centroids are the only thing held in memory: a
neighbour graph over them is searched best first. A query reads all lists whose
centroid is at most `probe_ratio` times as far as the nearest one, however many
they are. Lists near each other form a shard, and a shard with many vectors
several blocks: a query travels once to each block that holds one of its lists
and brings back k neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlspan.session import cut_lineage

#: Vectors a list should hold, before replicas.
LIST_SIZE = 64
#: Centroids take about this many bytes in each worker (up to three times as much after splits); at more vectors, lists grow instead.
CENTROID_BYTES = 64 << 20
#: Centroids are fitted on at most this many vectors a list, chosen by a hash of the id. All vectors are indexed.
FIT_ROWS = 32
ROUNDS = 4
#: Lists a vector may stand in, and how much farther than the nearest their centroid may be.
REPLICAS, CLOSURE = 4, 1.15
#: A query reads the lists whose centroid is within this ratio of the nearest one's distance.
PROBE_RATIO = 1.2
#: Lists that it reads however far they are: a query that stands on a centroid has none within any ratio.
LEAST_PROBES = 16
#: Beams of the search for a vector's lists and for a query's nearest one.
PLACE_BEAM, BEAM = 32, 128
DEGREE = 24
#: Lists in a shard, and vectors in a block of one.
SHARD_LISTS, BLOCK_ROWS = 64, 1 << 15


@dataclass(frozen=True)
class Graph:
    """Centroids with the neighbours of each and the entry points of a search."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def cells(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each point, the points that cells stand around): the nearest of n points taken at random."""
    pivots = points[np.random.default_rng(5).choice(len(points), min(n, len(points)), replace=False)]
    at = [squared(points[i : i + 4096], pivots).argmin(1) for i in range(0, len(points), 4096)]
    return np.concatenate(at), pivots


def graph(points: np.ndarray, degree: int = DEGREE) -> Graph:
    """Each centroid linked to its nearest ones in the 16 cells around it, and to a few at random that keep the graph connected.

    There are about as many cells as members of one, so that the work grows
    with n to the power of 1.5.
    """
    n = len(points)
    rng = np.random.default_rng(7)
    near = min(degree, max(n - 1, 0))
    links = np.empty((n, near + 4), np.int32)
    cell, pivots = cells(points, max(1, int(np.sqrt(n))))
    order = np.argsort(cell, kind="stable")
    at = np.searchsorted(cell[order], np.arange(len(pivots) + 1))
    reach = np.argsort(squared(pivots, pivots), axis=1, kind="stable")
    for c in np.flatnonzero(np.diff(at)):
        mine, around, have = order[at[c] : at[c + 1]], [], 0
        for k, other in enumerate(reach[c]):
            if k >= 16 and have > near:
                break
            around.append(order[at[other] : at[other + 1]])
            have += len(around[-1])
        around = np.concatenate(around)
        for i in range(0, len(mine), 1024):
            part = mine[i : i + 1024]
            d = squared(points[part], points[around])
            d[part[:, None] == around] = np.inf
            links[part, :near] = around[np.argpartition(d, near - 1, axis=1)[:, :near]] if near else 0
    ring = rng.permutation(n)
    after = np.empty(n, np.int32)
    after[ring] = np.roll(ring, -1)  # one cycle through all centroids
    links[:, near] = after
    links[:, near + 1 :] = rng.integers(0, n, (n, 3))
    return Graph(points, links, rng.choice(n, min(n, 32), replace=False).astype(np.int32))


def search(g: Graph, queries: np.ndarray, k: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of about the k nearest centroids of each query, nearest first; -1 and inf if there are fewer."""
    m, n, width = len(queries), len(g.points), max(beam, k, len(g.entries))
    q2, p2 = (queries * queries).sum(1), (g.points * g.points).sum(1)
    at = np.tile(g.entries, (m, 1))
    d = np.maximum(q2[:, None] + p2[at] - 2 * queries @ g.points[g.entries].T, 0)
    seen = np.zeros((m, n), bool)
    seen[:, g.entries] = True
    pad = max(0, width - at.shape[1])
    at = np.concatenate([at, np.full((m, pad), -1, np.int32)], 1)
    d = np.concatenate([d, np.full((m, pad), np.inf)], 1)
    open_ = at >= 0
    live = np.arange(m)
    while len(live):
        best = np.where(open_[live], d[live], np.inf)
        pick = best.argmin(1)
        go = best[np.arange(len(live)), pick] < np.inf
        live, pick = live[go], pick[go]
        if not len(live):
            break
        open_[live, pick] = False
        near = g.links[at[live, pick]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        dist = np.where(fresh, np.maximum(q2[live][:, None] + p2[near] - 2 * np.einsum("ij,ikj->ik", queries[live], g.points[near]), 0), np.inf)
        # a link named twice in one step counts once
        order = np.sort(near, 1)
        if (order[:, 1:] == order[:, :-1]).any():
            by = np.argsort(near, 1, kind="stable")
            again = np.zeros(near.shape, bool)
            s = np.take_along_axis(near, by, 1)
            np.put_along_axis(again, by, np.concatenate([np.zeros((len(s), 1), bool), s[:, 1:] == s[:, :-1]], 1), 1)
            dist[again] = np.inf
        all_d, all_at = np.concatenate([d[live], dist], 1), np.concatenate([at[live], near], 1)
        all_open = np.concatenate([open_[live], np.isfinite(dist)], 1)
        keep = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        d[live], at[live], open_[live] = (np.take_along_axis(x, keep, 1) for x in (all_d, all_at, all_open))
        at[live] = np.where(np.isfinite(d[live]), at[live], -1)
        open_[live] &= at[live] >= 0
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)


def within(g: Graph, queries: np.ndarray, ratio: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, centroid) of all centroids at most `ratio` times as far as the nearest one, by blocks of centroids."""
    d0 = search(g, queries, 1)[1]
    block = max(1024, (8 << 20) // max(len(queries), 1))
    for i in range(0, len(g.points), block):
        row, col = np.nonzero(squared(queries, g.points[i : i + block]) <= ratio**2 * d0)
        yield row, col + i


def _step(g: Graph) -> int:
    """Queries to search at once, so that the marks of what each has seen take at most 32 MB."""
    return max(16, min(512, (32 << 20) // len(g.points)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _clean(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) one row an id, v ARRAY<FLOAT> of the commonest length, without NULLs and non-finite values; that length."""
    v = F.col(vector).cast("array<float>")
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sizes = rows.filter(finite).groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    if sizes is None:
        return rows.limit(0), 0
    return rows.filter(finite & (F.size("v") == sizes["size"])).groupBy("id").agg(F.min("v").alias("v")), sizes["size"]


def centroids(rows: DataFrame, dim: int, n: int, list_size: int = LIST_SIZE, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of balanced lists over (id, v), about how many of the n rows are nearest to each).

    Lloyd rounds on FIT_ROWS rows a list, splitting lists of over twice the
    mean and dropping those under an eighth.
    """
    lists = int(max(1, min(-(-n // list_size), CENTROID_BYTES // (4 * dim))))
    share = min(1.0, FIT_ROWS * lists / n)
    if share < 1:
        rows = cut_lineage(rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))))
        n = rows.count()
    seeds = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(lists).toArrow()["v"].combine_chunks()
    points = _matrix(seeds, dim)
    rng = np.random.default_rng(3)
    held = np.ones(len(points))
    for _ in range(rounds):
        g = graph(points)

        def partial(batches: Iterator[pa.RecordBatch], g: Graph = g) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(g.points.shape), np.zeros(len(g.points), np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), dim)
                step = _step(g)
                for i in range(0, len(x), step):
                    at = search(g, x[i : i + step], 1, beam=16)[0][:, 0]
                    np.add.at(sums, at, x[i : i + step])
                    counts += np.bincount(at, minlength=len(counts))
            k = np.flatnonzero(counts)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(counts[k]), pa.array(list(sums[k]), pa.list_(pa.float64()))], ["list", "n", "s"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).flatten().to_numpy().reshape(-1, dim)) for b in batches if b.num_rows]
            if parts:
                at, c, s = (np.concatenate(x) for x in zip(*parts))
                k, back = np.unique(at, return_inverse=True)
                sums = np.zeros((len(k), dim))
                np.add.at(sums, back, s)
                n = np.bincount(back, c).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(list((sums / n[:, None]).astype(np.float32)), pa.list_(pa.float32()))], ["list", "n", "mean"])

        got = rows.select("v").mapInArrow(partial, "list int, n long, s array<double>").repartition("list").mapInArrow(total, "list int, n long, mean array<float>").toArrow().sort_by("list").combine_chunks()
        mean, count = _matrix(got["mean"].combine_chunks(), dim), got["n"].to_numpy()
        keep = (count >= n / lists / 8) | (len(count) == 1)
        mean, count = mean[keep], count[keep]
        long = count > 2 * n / lists
        spread = np.sqrt(np.median(squared(mean, mean) + np.eye(len(mean)) * 1e9, axis=1, keepdims=True)) * 0.05 if len(mean) > 1 else np.full((1, 1), 1e-3)
        shift = rng.standard_normal(mean.shape).astype(np.float32) * (spread if spread.ndim == 2 else 1e-3)
        points = np.concatenate([mean[~long], (mean + shift)[long], (mean - shift)[long]]).astype(np.float32)
        held = np.concatenate([count[~long], count[long] / 2, count[long] / 2])
    return points, held / share


def _placed(g: Graph, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the nearest list of each vector, and the next ones within CLOSURE that no nearer chosen centroid makes needless."""
    at, d = search(g, x, 2 * REPLICAS, PLACE_BEAM)
    keep = (at >= 0) & (d <= CLOSURE**2 * d[:, :1])
    keep[:, 0] = True
    for k in range(1, at.shape[1]):
        for j in range(k):
            both = keep[:, k] & keep[:, j]
            if both.any():
                r = np.flatnonzero(both)
                apart = ((g.points[at[r, k]] - g.points[at[r, j]]) ** 2).sum(1)
                keep[r[apart < d[r, k] * 0.3], k] = False
        keep[keep[:, : k + 1].sum(1) > REPLICAS, k] = False
    row, col = np.nonzero(keep)
    return row, at[row, col]


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, key: str = "vec_id", vector: str = "embedding", list_size: int = LIST_SIZE, probe_ratio: float = PROBE_RATIO) -> DataFrame:
    """`key`, neighbour_id, rank, distance: about the k nearest other vectors of every query, by Euclidean distance.

    The ids of `queries` (all by default) are searched among all vectors. Ties
    go to the smaller id. Rows with a NULL id, a NULL, empty or non-finite
    vector, or one whose length isn't the commonest (the shorter if two are)
    take no part; of rows that share an id the least vector counts; queries
    without a vector have no rows; with fewer than k others there are fewer
    rows; other columns are ignored; an empty table gives no rows.
    """
    rows, dim = _clean(vectors, key, vector)
    kind = vectors.schema[key].dataType.simpleString()
    if not dim:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, neighbour_id {kind}, rank int, distance double")
    rows = cut_lineage(rows)
    points, held = centroids(rows, dim, rows.count(), list_size)
    g = graph(points)
    shard = cells(points, -(-len(points) // SHARD_LISTS))[0]
    blocks = np.maximum(1, np.ceil(np.bincount(shard, held) * 2 / BLOCK_ROWS)).astype(np.int64)  # lists hold some replicas
    asked = rows if queries is None else rows.join(queries.select(F.col(key).alias("id")).distinct(), "id", "left_semi")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, salt = _matrix(batch.column(1), dim), batch.column(2).to_numpy()
            step = _step(g)
            for i in range(0, len(x), step):
                row, at = _placed(g, x[i : i + step])
                pick = pa.array(row + i)
                s = shard[at]
                one = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32)), pa.array(at.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array((salt[row + i] % blocks[s]).astype(np.int32)), pa.array(np.zeros(len(at), bool)), one, batch.column(0).take(pick), batch.column(1).take(pick)], _BLOCK)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            for i in range(0, len(x), 64):
                least, _ = search(g, x[i : i + 64], LEAST_PROBES)
                near = [(np.repeat(np.arange(len(least)), least.shape[1])[least.ravel() >= 0], least[least >= 0]), *within(g, x[i : i + 64], probe_ratio)]
                row, at = np.divmod(np.unique(np.concatenate([r * len(g.points) + c for r, c in near])), len(g.points))
                order = np.lexsort((at, shard[at], row))
                row, at = row[order], at[order].astype(np.int32)
                edge = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(shard[at]) != 0), [True]]))
                s = shard[at[edge[:-1]]]
                times = blocks[s]
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(at)).take(pa.array(np.repeat(np.arange(len(s)), times)))
                salt = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                pick = pa.array(np.repeat(row[edge[:-1]], times) + i)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s, times).astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(np.ones(len(salt), bool)), lists, batch.column(0).take(pick), batch.column(1).take(pick)], _BLOCK)

    schema = f"shard int, block int, asks boolean, lists array<int>, id {kind}, v array<float>"
    placed = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt")).mapInArrow(place, schema)
    met = placed.unionByName(asked.select("id", "v").mapInArrow(ask, schema)).repartition("shard", "block").sortWithinPartitions("shard", "block", "asks")
    found = met.mapInArrow(_scan(dim, k), f"q {kind}, id {kind}, d double").groupBy("q", "id").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))  # at most k rows of each block
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias(key), F.col("id").alias("neighbour_id"), "rank", F.sqrt("d").alias("distance"))


_BLOCK = ["shard", "block", "asks", "lists", "id", "v"]


def _scan(dim: int, k: int):
    """Over blocks, each one's vectors before its queries: the k nearest that a block has for each query. Queries pass by in slices."""

    def answers(members: pa.Table, queries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, x, lists = members["id"].combine_chunks(), _matrix(members["v"].combine_chunks(), dim), members["lists"].combine_chunks().flatten().to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], np.diff(lists) != 0, [True]]))
        of = {int(lists[a]): (a, b) for a, b in zip(edge[:-1], edge[1:])}
        step = max(1, min(512, (1 << 22) // len(x)))
        for i in range(0, queries.num_rows, step):
            part = queries.slice(i, step)
            q = _matrix(part.column(5), dim)
            wanted = part.column(3).flatten().to_numpy()
            row = np.repeat(np.arange(len(q)), np.diff(part.column(3).offsets.to_numpy()))
            order = np.argsort(wanted, kind="stable")
            wanted, row = wanted[order], row[order]
            d = np.full((len(q), len(x)), np.inf, np.float32)
            cut = np.flatnonzero(np.concatenate([[True], np.diff(wanted) != 0, [True]]))
            for a, b in zip(cut[:-1], cut[1:]):
                low, high = of.get(int(wanted[a]), (0, 0))
                if high > low:
                    d[row[a:b], low:high] = squared(q[row[a:b]], x[low:high])
            # a vector may stand in several lists of a block, and a query is no neighbour of its own
            few = min(REPLICAS * (k + 1), len(x)) - 1
            last = np.partition(d, few, axis=1)[:, few]
            r, c = np.nonzero((d <= last[:, None] * np.float32(1.0001) + np.float32(1e-4)) & np.isfinite(d))
            exact = ((q[r].astype(np.float64) - x[c]) ** 2).sum(1)
            both = pc.dictionary_encode(pa.chunked_array([ids, part.column(4)])).combine_chunks().indices.to_numpy()
            mine, other = both[len(ids) + r], both[c]
            rank = np.empty(len(ids), np.int64)
            rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            keep = np.flatnonzero(mine != other)
            keep = keep[np.lexsort((rank[c[keep]], exact[keep], r[keep]))]
            # a copy of a pair stands right behind it: equal distance, equal id
            keep = keep[np.concatenate([[True], (np.diff(r[keep]) != 0) | (np.diff(other[keep]) != 0)])] if len(keep) else keep
            first = np.flatnonzero(np.concatenate([[True], np.diff(r[keep]) != 0])) if len(keep) else keep
            keep = keep[np.arange(len(keep)) - np.repeat(first, np.diff(np.append(first, len(keep)))) < k]
            yield pa.RecordBatch.from_arrays([part.column(4).take(pa.array(r[keep])), ids.take(pa.array(c[keep])), pa.array(exact[keep])], ["q", "id", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, table = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            name = np.stack([batch.column(j).cast(pa.int64()).to_numpy(zero_copy_only=False) for j in range(3)], 1)
            edge = np.flatnonzero(np.concatenate([[True], (np.diff(name, axis=0) != 0).any(1), [True]]))
            for a, b in zip(edge[:-1], edge[1:]):
                part, block = batch.slice(a, b - a), tuple(name[a, :2])
                if block != now:
                    now, held, table = block, [], None
                if not name[a, 2]:
                    held.append(part)
                elif held:
                    if table is None:
                        table = pa.Table.from_batches(held).combine_chunks()
                        first = table["lists"].combine_chunks().flatten()
                        table = table.take(pc.sort_indices(first)).combine_chunks()
                    yield from answers(table, part)

    return run
