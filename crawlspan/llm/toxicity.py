"""Character n-gram linear classifier on naive Bayes log-count ratios.

A feature is the presence of a hashed character n-gram, its value the log
ratio of how often toxic and clean labelled texts hold it. A logistic
regression over those values is trained on labelled text; scoring adds up the
weights of the n-grams that a whole text holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from crawlspan.llm import text as T
from crawlspan.session import cut_lineage

ORDERS = (3, 4, 5)
BITS = 22


@dataclass(frozen=True)
class Model:
    """Weight (coefficient times log-count ratio) of each selected bucket, sorted by bucket, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def _codes(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points and their offsets, of flat UTF-8."""
    lead = np.flatnonzero((body & 0xC0) != 0x80)
    return T.codepoints(body, lead), np.searchsorted(lead, offsets)


def _grams(codes: np.ndarray, bits: int = BITS) -> Iterator[tuple[int, np.ndarray]]:
    """(n, bucket of codes i..i+n-1 for every i), whether or not a text ends within."""
    h = np.zeros(len(codes) + 1, np.uint64)
    c = codes.astype(np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        with np.errstate(over="ignore"):
            h = h[:m] * np.uint64(0x100000001B3) + c[n - 1 :]
            if n in ORDERS:
                yield n, (((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32)


def features(body: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a flat lower-case text column; only buckets where `table` is true, if given."""
    codes, at = _codes(body, offsets)
    found = []
    for n, bucket in _grams(codes, bits):
        i = np.flatnonzero(table[bucket]) if table is not None else np.arange(len(bucket))
        row = np.searchsorted(at, i, "right") - 1
        inside = i + n <= at[row + 1]
        found.append((row[inside].astype(np.int64) << bits) | bucket[i[inside]])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> bits, keys & ((1 << bits) - 1)


def _labelled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, bound: int) -> DataFrame:
    """(y, text) of at most `bound` labelled ids, chosen by hash; of one text under many ids, one row a class."""
    named = labels.select(F.col(key).alias("_k"), F.col(label).alias("_y")).dropna().groupBy("_k").agg(F.max("_y").cast("int").alias("_y"))
    chosen = named.orderBy(F.xxhash64("_k"), "_k").limit(bound)
    rows = docs.select(F.col(key).alias("_k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    # at most `bound` rows of 12 bytes: safe to broadcast at any size of the tables
    return rows.join(F.broadcast(chosen), "_k").select("_y", "_t", F.xxhash64("_t").alias("_h"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", bound: int = 20_000, least_z: float = 5.0, least_ratio: float = 2.0, alpha: float = 1.0, ridge: float = 1e-3) -> Model:
    """Fits the classifier on at most `bound` labelled documents, chosen by a hash of their id.

    N-gram counts are summed by executors; the driver gets those n-grams alone
    whose shares among toxic and clean texts differ by `least_z` standard
    errors and by a factor of `least_ratio`, and for each training text the ones
    of them that it holds. Of n training texts no n-gram can reach more than
    sqrt(n) standard errors, so that of under 100 texts half of that is asked.
    The training texts are read from `docs` once and kept in the shared folder.
    Several labels of one id count as their maximum; labels without a document, and NULL
    labels, don't count. Without both classes the model has no features and
    rejects nothing.
    """
    rows = _labelled(docs, labels, text, key, label, bound)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            y = (batch.column(0).to_numpy() != 0).astype(np.int64)
            body, offsets = T.flat(batch.column(1))
            for i, j in T.slices(offsets, 1 << 20):
                row, bucket = features(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                np.add.at(counts, (y[i:j][row], bucket), 1)
        k = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(counts[0][k], pa.int64()), pa.array(counts[1][k], pa.int64())], ["bucket", "clean", "toxic"])

    # one row for each copy of a text would count a passage once for every copy
    rows = rows.repartition(max(8, bound // 1000), "_h")
    unique = cut_lineage(rows.groupBy("_h").agg(F.max("_y").alias("_y"), F.first("_t").alias("_t")).select("_y", "_t"))
    seen = {r.toxic: r.n for r in unique.groupBy((F.col("_y") != 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0)
    nt, nc = seen[True], seen[False]
    summed = unique.mapInArrow(T.tidy(held), "bucket int, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    pool = (F.col("clean") + F.col("toxic")) / (nt + nc)
    z = (F.col("toxic") / nt - F.col("clean") / nc) / F.sqrt(pool * (1 - pool) * (1 / nt + 1 / nc))
    log_ratio = F.log((F.col("toxic") + alpha) / (nt + alpha)) - F.log((F.col("clean") + alpha) / (nc + alpha))
    chosen = summed.filter(pool < 1).filter(F.abs(z) >= min(least_z, 0.5 * float(np.sqrt(nt + nc)))).select("bucket", log_ratio.alias("ratio")).filter(F.abs("ratio") >= float(np.log(least_ratio))).toArrow().sort_by("bucket")
    if not chosen.num_rows:
        return Model(np.zeros(0, np.int64), np.zeros(0), -20.0)
    buckets, ratio = chosen["bucket"].to_numpy().astype(np.int64), chosen["ratio"].to_numpy()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(1 << BITS, bool)
        mask[buckets] = True
        for batch in batches:
            body, offsets = T.flat(batch.column(1))
            for i, j in T.slices(offsets):
                row, bucket = features(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], mask)
                at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.searchsorted(buckets, bucket).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["y", "f"])

    got = unique.mapInArrow(T.tidy(present), "y int, f array<int>").toArrow().combine_chunks()
    y = (got["y"].to_numpy() != 0).astype(float)
    lists = got["f"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    column = lists.flatten().to_numpy()
    coef, bias = _logistic(np.repeat(np.arange(len(y), dtype=np.int32), sizes), column, ratio, y, ridge)
    return Model(buckets, coef * ratio, bias)


def _logistic(row: np.ndarray, column: np.ndarray, value: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression over binary features scaled by `value`: Newton steps solved by conjugate gradients."""
    n, d = len(y), len(value)
    ahead = lambda w: np.bincount(row, (w[:d] * value)[column], minlength=n) + w[d]
    back = lambda u: np.append(np.bincount(column, u[row], minlength=d) * value, u.sum())
    penal = np.append(np.full(d, ridge * n), 1e-9)
    w = np.zeros(d + 1)
    w[d] = np.log((y.sum() + 1) / (n - y.sum() + 1))
    loss = lambda w: np.logaddexp(0, ahead(w)).sum() - y @ ahead(w) + 0.5 * (penal * w * w).sum()
    now = loss(w)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(ahead(w), -30, 30)))
        g = back(p - y) + penal * w
        curve = p * (1 - p) + 1e-6
        step, r = np.zeros(d + 1), -g
        v, rr = r.copy(), r @ r
        for _ in range(40):
            hv = back(curve * ahead(v)) + penal * v
            a = rr / (v @ hv)
            step += a * v
            r = r - a * hv
            new = r @ r
            if new < 1e-8 * (g @ g):
                break
            v, rr = r + new / rr * v, new
        size = 1.0
        while (after := loss(w + size * step)) > now and size > 1e-4:
            size /= 2
        if now - after < 1e-6 * abs(now):
            break
        w, now = w + size * step, after
    return w[:d], float(w[d])


def scores(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """`key`, toxicity (probability) of every row; narrow, one Arrow pass over whole texts.

    NULL and empty texts hold no n-gram and get the model's base rate; repeated
    rows and ids are scored each; a NULL id stays NULL; other columns are
    ignored; an empty table gives no rows.
    """
    schema = StructType([StructField(key, docs.schema[key].dataType), StructField("toxicity", DoubleType())])
    return docs.select(F.col(key), F.lower(F.col(text)).alias("_t")).mapInArrow(T.tidy(_scorer(model, key, bits)), schema)


def _scorer(model: Model, key: str, bits: int = BITS):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << bits, np.float32)
        weight[model.buckets] = model.weights
        mask = weight != 0
        for batch in batches:
            body, offsets = T.flat(batch.column(1))
            total = np.full(batch.num_rows, model.bias)
            for i, j in T.slices(offsets):
                row, bucket = features(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], mask, bits)
                total[i:j] += np.bincount(row, weight[bucket], minlength=j - i)
            p = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], [key, "toxicity"])

    return run


def toxic(docs: DataFrame, model: Model, threshold: float = 0.35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key`, toxicity, is_toxic of the rows whose probability reaches `threshold`: what a filter rejects."""
    return scores(docs, model, text, key).filter(F.col("toxicity") >= threshold).withColumn("is_toxic", F.lit(True))


def accept(docs: DataFrame, model: Model, threshold: float = 0.35, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they were, below `threshold`. NULL and empty texts stay.

    Each row is judged by itself, repeated rows and NULL ids too; columns may
    have any name and type; an empty table stays empty. The score is taken beside the row, so nothing is joined or shuffled.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"))
    return scores(row, model, "_text", "_row").filter(F.col("toxicity") < threshold).select("_row.*")
