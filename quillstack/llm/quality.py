"""A quality classifier on random-indexing word vectors.

Tokens are runs of letters, digits or other marks. Each falls into one of BUCKETS word buckets; a bucket's index vector
is sparse, random and fixed, and its word vector sums the index vectors of its neighbours over all documents. A document
is the mean and spread of its tokens' unit vectors, with its length and its share of distinct tokens. A network of two
layers, in numpy, learns the label from a bounded sample of labelled rows; the temperature that calibrates its
probabilities is fitted on a part that the network hasn't seen.

Defined results: null and empty texts are scored as texts without tokens; labels that are null or without a document
teach nothing; of several labels for one doc_id the largest counts; with fewer than two classes to learn from, the score
is the share of label 1 among them, or 0.5 with none; repeated rows get equal scores; a null doc_id is scored as well;
columns of the input pass through, unless they are named score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import save
from .textbytes import Spans, mix, pieces, utf8

BUCKETS = 1 << 14
WIDTH = 32
REACH = 2
SAMPLE = 20_000  # labelled rows that the network learns from, those with the smallest hashes
HIDDEN = 32
ROUNDS = 60
KIND = np.full(256, 3, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
_codes = mix(np.arange(2 * BUCKETS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, BUCKETS)
PLACES = (_codes % np.uint64(WIDTH)).astype(np.int64)
SIGNS = np.where((_codes >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def learnable(mod: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod != held, F.lit(False))


def token_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each token, in order."""
    body = data[offs[0] : offs[-1]]
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edge = offs - offs[0]
    kind = KIND[body]
    head = np.ones(len(body), bool)
    head[1:] = kind[1:] != kind[:-1]
    head[edge[:-1][edge[:-1] < len(body)]] = True
    at = np.flatnonzero(head)
    end = np.append(at[1:], len(body))
    solid = kind[at] != 0
    at, end = at[solid], end[solid]
    return np.searchsorted(edge, at, "right") - 1, Spans(body).of(at, end)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc, hashes = token_hashes(data, offs)
    return doc, (hashes % np.uint64(BUCKETS)).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors by bucket, from the neighbours in all documents."""
    names = [f"v{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * WIDTH)
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for lo, hi in pieces(offs):
                doc, bucket = tokens(data, offs[lo : hi + 1])
                for step in range(1, REACH + 1):
                    near = doc[step:] == doc[:-step]
                    left, right = bucket[:-step][near], bucket[step:][near]
                    for places, signs in zip(PLACES, SIGNS):
                        total += np.bincount(left * WIDTH + places[right], signs[right], len(total))
                        total += np.bincount(right * WIDTH + places[left], signs[left], len(total))
        table = total.reshape(BUCKETS, WIDTH).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(table[used, i]) for i in range(WIDTH))], ["bucket", *names])

    sums = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    table = np.zeros((BUCKETS, WIDTH), np.float32)  # BUCKETS rows at most
    table[sums["bucket"].to_numpy()] = sums[names].to_numpy(np.float32)
    return table / np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))


def pooled(data: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    rows = len(offs) - 1
    doc, bucket = tokens(data, offs)
    count = np.bincount(doc, minlength=rows)
    mean, spread, distinct = np.zeros((rows, WIDTH), np.float32), np.zeros((rows, WIDTH), np.float32), np.zeros(rows)
    if len(doc):
        full = np.flatnonzero(count)
        start = np.concatenate([[0], np.cumsum(count[full])[:-1]])
        each = vectors[bucket]
        n = count[full, None]
        mean[full] = np.add.reduceat(each, start) / n
        spread[full] = np.sqrt(np.maximum(0, np.add.reduceat(each * each, start) / n - mean[full] ** 2))
        key = np.unique(doc * BUCKETS + bucket)
        distinct = np.bincount(key // BUCKETS, minlength=rows) / np.maximum(1, count)
    return np.column_stack([mean, spread, np.log1p(count), distinct]).astype(np.float32)


class Network:
    """Two layers with a temperature; inputs are standardised."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.middle, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.middle) / self.scale
        held = rng.random(len(x)) < 0.2
        if len(np.unique(y[~held])) < 2 or not held.any():
            held[:] = False
        a, b = x[~held], y[~held].astype(np.float32)
        shape = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, 1), (1,)]
        self.parts = [(rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for s in shape]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in self.parts]
        self.temperature, step = 1.0, 0
        for _ in range(ROUNDS):
            order = rng.permutation(len(a))
            for lo in range(0, len(a), 256):
                rows = order[lo : lo + 256]
                w, c, v, d = self.parts
                h = np.maximum(0, a[rows] @ w + c)
                p = 1 / (1 + np.exp(-np.clip((h @ v + d)[:, 0], -30, 30)))
                g = ((p - b[rows]) / len(rows))[:, None]
                gh = (g @ v.T) * (h > 0)
                step += 1
                for i, grad in enumerate((a[rows].T @ gh + 1e-4 * w, gh.sum(0), h.T @ g + 1e-4 * v, g.sum(0))):
                    m, s = moments[i]
                    m += 0.1 * (grad - m)
                    s += 0.001 * (grad * grad - s)
                    self.parts[i] -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        if held.any():
            z, t = self.logits(x[held]), y[held]
            losses = {c: np.mean(np.logaddexp(0, z / c) - t * z / c) for c in np.geomspace(0.25, 8, 41)}
            self.temperature = float(min(losses, key=losses.get))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, c, v, d = self.parts
        return (np.maximum(0, x @ w + c) @ v + d)[:, 0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = self.logits((x - self.middle) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "quality", most_labels: int = SAMPLE) -> DataFrame:
    """All rows of docs with score, the probability of label 1. rows: which doc_ids may teach; most_labels of them at most."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y")).where(rows)
    taught = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for lo, hi in pieces(offs, 1 << 19):
                x = pooled(data, offs[lo : hi + 1], vectors)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), lists], ["y", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(save(taught, "taught")), "doc_id").select("text", "_y").mapInArrow(features, "y int, x array<float>").toPandas()  # most_labels rows
    y = sample["y"].to_numpy(np.int64)
    usual = float(y.mean()) if len(y) else 0.5
    network = None
    if len(np.unique(y)) > 1:
        x = np.stack(sample["x"].to_numpy()).astype(np.float32)
        order = np.lexsort((*x.T, y))  # the same rows in the same order, however Spark delivers them
        network = Network(x[order], y[order])
    names = [c for c in docs.columns if c.lower() != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            out = np.full(batch.num_rows, usual)
            if network:
                for lo, hi in pieces(offs, 1 << 19):
                    out[lo:hi] = network(pooled(data, offs[lo : hi + 1], vectors))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out)], [*names, "score"])

    return docs.select(*names).mapInArrow(run, T.StructType([*(docs.schema[n] for n in names), T.StructField("score", T.DoubleType())]))
