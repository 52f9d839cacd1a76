"""SimHash near-duplicates, every pair within the radius.

A text's signature is 128 sign bits over its distinct words. Its bits are
parted into blocks, so many that two signatures within the radius differ by at
most 2 bits in one of them (7 blocks of 18 bits for a radius of 20). Such blocks
have a value in common if one bit of either may be flipped; hence each signature
enters, in each block, the bucket of its own value and those of the values a bit
away, and whatever shares a bucket is compared. No pair at the radius is left to
chance. Only the first bits of a block name the shards that travel, one row for
the name and one for each name a bit away; the values are made where they are
compared. `build` and `search` are the BK-tree of a few signatures; among many
unrelated ones it prunes little at this radius, and `groups` doesn't use it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from crawlspan.llm import text as T
from crawlspan.session import cut_lineage

BITS = 128
RADIUS = 20
#: Chance that a pair at the radius meets in the sampled shards of `sharding`, which `groups` doesn't use.
RECALL = 0.995


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, hi, lo: the signature of each row with at least one word; both are NULL without.

    Words are compared in lower case, whatever stands between them; each
    distinct word counts once, and the order plays no part.
    """
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("hi", LongType()), StructField("lo", LongType())])
    return docs.select(F.col(key), F.lower(F.col(text)).alias("_t")).mapInArrow(T.tidy(_signer(key)), schema)


def _signer(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = T.flat(batch.column(1))
            words = np.zeros((batch.num_rows, 2), np.uint64)
            some = np.zeros(batch.num_rows, bool)
            for i, j in T.slices(offsets, 1 << 20):
                words[i:j], some[i:j] = sign(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            halves = [pa.array(words[:, k].view(np.int64), mask=~some) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *halves], [key, "hi", "lo"])

    return run


def sign(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((hi, lo), has words) of each row of a flat lower-case column."""
    n = len(offsets) - 1
    starts, ends = T.word_spans(body, offsets)
    out, some = np.zeros((n, 2), np.uint64), np.zeros(n, bool)
    if not len(starts):
        return out, some
    row = T.row_of(starts, offsets).astype(np.uint64)
    keys = np.unique((row << np.uint64(40)) | (T.span_hashes(body, starts, ends) >> np.uint64(24)))
    row = (keys >> np.uint64(40)).astype(np.int64)
    word = keys & np.uint64((1 << 40) - 1)
    for i in range(0, len(keys), 1 << 17):  # so that the bit matrix stays at 16 MB; a long row goes on in the next part
        part, r = word[i : i + (1 << 17)], row[i : i + (1 << 17)]
        bits = np.unpackbits(np.stack([T.mix(part), T.mix(part ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1).view(np.uint8), axis=1)
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        sums = np.add.reduceat(bits, first, axis=0, dtype=np.int32) * 2 - np.diff(np.append(first, len(r)))[:, None].astype(np.int32)
        if i and r[0] == carry_row:
            sums[0] += carry
        carry_row, carry = r[-1], sums[-1]
        out[r[first]] = np.packbits(sums > 0, axis=1).view(np.uint64)
        some[r[first]] = True
    return out, some


def sharding(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(bits of a shard's key, samples) for n signatures: shards of about 16 by chance, and samples enough for RECALL at the radius."""
    bits = max(4, int(np.ceil(np.log2(max(n, 2)))) - 4)
    meet = float(np.prod(1 - radius / (BITS - np.arange(bits))))  # none of the sampled bits is among those that differ
    return bits, int(np.ceil(np.log(1 - RECALL) / np.log(1 - meet)))


def _positions(bits: int, samples: int) -> np.ndarray:
    """The sampled bits, the same in every task."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.choice(BITS, bits, replace=False) for _ in range(samples)])


def shard_keys(words: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Sampled bits of (hi, lo) rows, one key a row and sample."""
    keys = np.zeros((len(words), len(positions)), np.int64)
    for k in range(positions.shape[1]):
        for s, p in enumerate(positions[:, k]):
            keys[:, s] = (keys[:, s] << 1) | ((words[:, p >> 6] >> np.uint64(63 - (p & 63))) & np.uint64(1)).astype(np.int64)
    return keys


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def build(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge) of a BK-tree for each group of equal, adjacent values; roots are their own parents.

    Every item descends at once: at its node it takes the child at its distance,
    or, first of those that come for a missing child, becomes it.
    """
    n = len(words)
    parent, edge = np.arange(n), np.zeros(n, np.int64)
    first = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
    root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
    item, node = np.flatnonzero(~first), root[~first]
    while len(item):
        d = distance(words[item], words[node])
        slot = node * (BITS + 1) + d
        _, at, back = np.unique(slot, return_index=True, return_inverse=True)
        child = item[at]
        parent[child], edge[child] = node[at], d[at]
        on = np.ones(len(item), bool)
        on[at] = False
        item, node = item[on], child[back][on]
    return parent, edge


def search(words: np.ndarray, group: np.ndarray, radius: int, chunk: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair (query, node) with query > node in one group within the radius, through the groups' BK-trees."""
    parent, edge = build(words, group)
    n = len(words)
    child = np.flatnonzero(parent != np.arange(n))
    slot = parent[child] * (BITS + 1) + edge[child]
    order = np.argsort(slot, kind="stable")
    child, slot = child[order], slot[order]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
    root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
    ask = np.flatnonzero(root != np.arange(n))
    stack = [(ask[i : i + chunk], root[ask[i : i + chunk]]) for i in range(0, len(ask), chunk)]
    while stack:
        query, node = stack.pop()
        d = distance(words[query], words[node])
        near = (d <= radius) & (node < query)
        if near.any():
            yield query[near], node[near]
        base = node * (BITS + 1)
        low = np.searchsorted(slot, base + np.maximum(d - radius, 0))
        high = np.searchsorted(slot, base + np.minimum(d + radius, BITS), "right")
        k = high - low
        if k.any():
            total = np.cumsum(k)
            at = np.arange(total[-1]) - np.repeat(total - k, k) + np.repeat(low, k)
            query, node = np.repeat(query, k), child[at]
            stack += [(query[i : i + chunk], node[i : i + chunk]) for i in range(0, len(query), chunk)]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each item's component under the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (deeper := new[new]).tobytes() != new.tobytes():
            new = deeper
        if (new == label).all():
            return label
        label = new


def blocks(radius: int) -> np.ndarray:
    """Places of each block's bits. Of `radius` differing bits some block has at most 2: with 3 in each there would be more."""
    n = min(radius, BITS) // 3 + 1
    size = min(BITS // n, 24)
    return _positions(BITS, 1)[0][: n * size].reshape(n, size)


def naming(n: int, size: int) -> int:
    """Bits of a block that name its shard, the more the more signatures there are; what is found doesn't depend on it."""
    return int(np.clip(np.ceil(np.log2(max(n, 2))) - 13, 0, size))


def shard_names(words: np.ndarray, places: np.ndarray, top: int) -> np.ndarray:
    """For each (hi, lo) row and block the shards it goes to: that of the block's first `top` bits and those one bit away."""
    flips = np.concatenate([[0], 1 << np.arange(top)])
    return (shard_keys(words, places) >> (places.shape[1] - top))[:, :, None] ^ flips


def variants(words: np.ndarray, places: np.ndarray, top: int, name: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of one shard: the bits of the shard's block as they are and with any one flipped, where the first are its name.

    Blocks that differ in 2 bits have values in common: each with one of the two flipped.
    """
    values = shard_keys(words, places[None]) ^ np.concatenate([[0], 1 << np.arange(len(places))])
    row, at = np.nonzero(values >> (len(places) - top) == name)
    return row, values[row, at]


#: Pairs that are held at once.
PAIRS = 1 << 17


def linked(words: np.ndarray, row: np.ndarray, value: np.ndarray, radius: int) -> np.ndarray:
    """The least row that each row is connected with, where rows of one value are linked if they differ by at most `radius` bits.

    Every two rows of a value are compared, save those of its family if that
    makes up most of them: rows near one and the same row are connected anyway.
    """
    label = np.arange(len(words))
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    new = np.concatenate([[True], value[1:] != value[:-1]]) if len(row) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(row)))
    large = np.argsort(-size, kind="stable")
    large = large[size[large] > 1]
    start, size = start[large], size[large]
    if not len(size):
        return label
    row = row[_ranges(start, size)]
    start = np.cumsum(size) - size
    bucket = np.repeat(np.arange(len(size)), size)
    # the family of a bucket: the rows near its first, or, in a large one, near the one of four that has most
    family, members = np.zeros(len(row), bool), np.zeros(len(size), np.int64)
    for quarter in range(4):
        some = int((size > 64).sum()) if quarter else len(size)
        if not some:
            break
        m = int(size[:some].sum())
        lead = row[(start + size * quarter // 4)[bucket[:m]]]
        near = distance(words[row[:m]], words[lead]) <= radius
        apart = near & (lead != row[:m])
        label = roots(len(words), np.concatenate([lead[apart], np.arange(len(words))]), np.concatenate([row[:m][apart], label]))
        count = np.bincount(bucket[:m][near], minlength=some)
        more = count > members[:some]
        members[:some][more] = count[more]
        family[:m] = np.where(more[bucket[:m]], near, family[:m])
    held, found = 0, []

    def hold(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal held, label
        found.append((a, b))
        held += len(a)
        if held > PAIRS:
            a, b = (np.concatenate(x) for x in zip(*found))
            label = roots(len(words), np.concatenate([a, np.arange(len(words))]), np.concatenate([b, label]))
            found.clear()
            held = 0

    heavy = members * members * 2 > size * size
    # buckets that a family makes up: each of the others with every row
    other = np.flatnonzero(heavy[bucket] & ~family)
    for i, j in T.slices(np.concatenate([[0], np.cumsum(size[bucket[other]])]), PAIRS):
        o = other[i:j]
        a, b = row[np.repeat(o, size[bucket[o]])], row[_ranges(start[bucket[o]], size[bucket[o]])]
        near = (distance(words[a], words[b]) <= radius) & (a != b)
        hold(a[near], b[near])
    # the rest: each row with the k-th after it, in the buckets that have as many
    rest = np.flatnonzero(~heavy[bucket])
    row, bucket = row[rest], bucket[rest]
    hi, lo = (np.ascontiguousarray(words[row, k]) for k in (0, 1))
    down = -size[bucket]
    for k in range(1, int(-down.min(initial=0))):
        m = int(np.searchsorted(down, -k))
        d = np.bitwise_count(hi[k:m] ^ hi[: m - k])
        at = np.flatnonzero(d <= radius)
        at = at[bucket[at] == bucket[at + k]]
        at = at[d[at] + np.bitwise_count(lo[at] ^ lo[at + k]).astype(np.int64) <= radius]
        hold(row[at], row[at + k])
    if found:
        a, b = (np.concatenate(x) for x in zip(*found))
        label = roots(len(words), np.concatenate([a, np.arange(len(words))]), np.concatenate([b, label]))
    return label


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of n numbers each, one after another."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _searcher(radius: int, top: int):
    """Over (block, name, hi, lo) rows, whole shards together: star edges of what is near, at most one a signature."""
    places = blocks(radius)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        block, name, hi, lo = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((lo, hi, name, block))
        block, name = block[order], name[order]
        words = np.stack([hi[order], lo[order]], 1).view(np.uint64)
        del hi, lo, order
        distinct, number = _number(words)
        label, found, held = np.arange(len(distinct)), [], 0
        edge = np.flatnonzero(np.concatenate([[True], (np.diff(block) != 0) | (np.diff(name) != 0), [True]]))
        for i, j in zip(edge[:-1], edge[1:]):
            least = linked(words[i:j], *variants(words[i:j], places[block[i]], top, int(name[i])), radius)
            at = np.flatnonzero(least != np.arange(j - i))
            found.append((number[i + at], number[i + least[at]]))
            held += len(at)
            if held > PAIRS or j == len(words):
                a, b = (np.concatenate(x) for x in zip(*found))
                label = roots(len(distinct), np.concatenate([a, np.arange(len(distinct))]), np.concatenate([b, label]))
                found, held = [], 0
        moved = np.flatnonzero(label != np.arange(len(distinct)))
        ends = np.concatenate([distinct[moved], distinct[label[moved]]], 1).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, k])) for k in range(4)], ["uh", "ul", "vh", "vl"])

    return run


def _number(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, number of each row)."""
    order = np.lexsort((words[:, 1], words[:, 0]))
    s = words[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]).any(1)])
    number = np.empty(len(words), np.int64)
    number[order] = np.cumsum(new) - 1
    return s[new], number


def components(edges: DataFrame) -> DataFrame:
    """u, root (least member) for every node of (u, v) edges with another root: alternating large and small stars.

    Each round is two shuffles of the edges, at most one edge a node and task;
    rounds grow with the logarithm of a component's width. Each is written to
    the shared folder, so that a lost executor costs one round.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    while True:
        m = both(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both(edges).join(m, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = cut_lineage(small.filter("u != v").distinct())
        if after.count() == edges.count() and not after.join(edges, ["u", "v"], "left_anti").take(1):
            return after.select("u", F.col("v").alias("root"))
        edges = after


def groups(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): `key`, th (hash of the text), hi, lo of each row with words; and hi, lo, keeper, kt, kh, kl, members for each signature whose group has several rows."""
    signed = signatures(docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("th")).alias("_r"), text), text, "_r")
    rows = cut_lineage(signed.filter(F.col("hi").isNotNull()).select(F.col("_r.id").alias(key), F.col("_r.th").alias("th"), "hi", "lo"))
    first = F.min(F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), "th")).alias("least")
    distinct = cut_lineage(rows.groupBy("hi", "lo").agg(first, F.count(F.lit(1)).alias("n")))
    places = blocks(radius)
    top = naming(distinct.count(), places.shape[1])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = (c.to_numpy() for c in batch.columns)
            for i in range(0, len(hi), 1 << 12):
                h, w = hi[i : i + (1 << 12)], lo[i : i + (1 << 12)]
                names = shard_names(np.stack([h, w], 1).view(np.uint64), places, top)
                block = np.broadcast_to(np.arange(len(places), dtype=np.int32)[None, :, None], names.shape).ravel()
                times = names[0].size if len(h) else 0
                yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(names.ravel()), pa.array(np.repeat(h, times)), pa.array(np.repeat(w, times))], ["block", "name", "hi", "lo"])

    shards = distinct.select("hi", "lo").mapInArrow(spread, "block int, name long, hi long, lo long").repartition("block", "name")
    found = shards.mapInArrow(T.tidy(_searcher(radius, top)), "uh long, ul long, vh long, vl long")
    pair = lambda a, b: F.struct(F.col(a).alias("hi"), F.col(b).alias("lo"))
    rooted = components(found.select(pair("uh", "ul").alias("u"), pair("vh", "vl").alias("v")))
    rooted = rooted.select(F.col("u.hi").alias("hi"), F.col("u.lo").alias("lo"), "root")
    named = distinct.join(rooted, ["hi", "lo"], "left").withColumn("root", F.coalesce("root", F.struct("hi", "lo")))
    kept = named.groupBy("root").agg(F.min(F.struct("least", "hi", "lo")).alias("k"), F.sum("n").alias("members")).filter("members > 1")
    out = named.join(kept, "root").select("hi", "lo", F.col("k.least.id").alias("keeper"), F.col("k.least.th").alias("kt"), F.col("k.hi").alias("kh"), F.col("k.lo").alias("kl"), "members")
    return rows, cut_lineage(out)


def _own(key: str):
    """Whether a row is its group's keeper."""
    return F.col(key).eqNullSafe(F.col("keeper")) & (F.col("th") == F.col("kt")) & (F.col("hi") == F.col("kh")) & (F.col("lo") == F.col("kl"))


def duplicates(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, keeper_id, members, exact: each row that a near-duplicate group gives up for its keeper.

    A group is a connected set of rows whose signatures differ by at most
    `radius` bits; its keeper is its least id (NULL ids last, then the least
    hash of the text), `members` its number of rows, `exact` says whether the
    signatures are equal. A repeated row is a copy like any other: its id then
    equals keeper_id. Rows without a word (NULL, empty, punctuation) are in no
    group. Every signature is a query, no shard or group is capped, and every
    pair within the radius is found, at any size of the table. Other columns
    are ignored; an empty table gives no rows.
    """
    rows, out = groups(docs, radius, text, key)
    mine = rows.groupBy(key, "th", "hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    each = mine.join(out, ["hi", "lo"]).withColumn("n", F.col("n") - F.when(_own(key), 1).otherwise(0)).filter("n > 0")
    exact = (F.col("hi") == F.col("kh")) & (F.col("lo") == F.col("kl"))
    return each.select(F.col(key), F.col("keeper").alias("keeper_id"), "members", exact.alias("exact"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i")).drop("_i")


#: Beyond this many bytes, what is to go is joined by a shuffle instead of a broadcast.
BROADCAST_BYTES = 32 << 20


def accept(docs: DataFrame, radius: int = RADIUS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, all columns as they were, with one row of each near-duplicate group.

    Which row stays is told by `duplicates`; rows without a word, NULL ones too,
    all stay. Where the keeper's own row is repeated, one copy of it stays.
    Columns may have any name and type; an empty table stays empty. Texts are
    signed once; what goes is then found by id and text hash.
    """
    rows, out = groups(docs, radius, text, key)
    mine = rows.groupBy(key, "th", "hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    judged = mine.join(out, ["hi", "lo"]).select(F.col(key).alias("_id"), F.col("th").alias("_th"), _own(key).alias("_own"), (F.col("n") > 1).alias("_many"))
    gone = cut_lineage(judged.filter("NOT _own OR _many"))
    if gone.count() * 40 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(text).alias("_key"))
    match = F.col(f"_row.`{key}`").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_th"))
    kept = packed.join(gone, match, "left").filter(F.col("_own").isNull() | F.col("_own"))
    if not gone.filter("_own AND _many").take(1):
        return kept.select("_row.*")
    once = kept.filter("_own").dropDuplicates(["_id", "_th"])
    return kept.filter("_own IS NULL").unionByName(once).select("_row.*")
