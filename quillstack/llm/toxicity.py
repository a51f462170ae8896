"""Toxicity by non-negative positive-unlabelled learning.

Texts that are labelled toxic are the positives; other texts are unlabelled, whatever their label. Of the tokens (runs of
letters of the lower-cased text) of all texts that may teach, those most typical of the positives are the features. A
linear numpy classifier minimises the non-negative risk: prior * R+(positives) + max(0, R-(unlabelled) - prior *
R-(positives)), with the prior from the labels that may teach. Where the second part turns negative, its gradient is
reversed. R-(unlabelled) is over all unlabelled texts: those with the same features become one row with a count, and each
step sums loss and gradient over these rows in tasks. Only the positives of the risk are bounded, by `most_positives`.

Defined results: null and empty texts are scored as texts without tokens; labels that are null or without a document
teach nothing; of several labels for one doc_id the largest counts; without a positive, all scores are 0; repeated rows
get equal scores; a null doc_id is scored as well; columns of the input pass through, unless they are named score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import token_hashes
from .scratch import save
from .textbytes import pieces, utf8

MOST_POSITIVES = 10_000  # labelled positives in the risk: those with the smallest hashes
SMALL_IDS = 500_000  # ids of positives up to which they are broadcast (8 MB); beyond, both sides shuffle
FEATURES = 512
LEAST_SHARE = 0.002
STEPS, RATE, START = 100, 0.05, 0.5  # chosen on folds of rows that may teach


def distinct_tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc, hashes = token_hashes(data, offs)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


class Features:
    """Presence of the chosen tokens, and their share among a text's tokens."""

    def __init__(self, chosen: np.ndarray):
        self.place = np.argsort(chosen)
        self.sorted = chosen[self.place]

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of each chosen token present."""
        doc, hashes = distinct_tokens(data, offs)
        if not len(self.sorted):
            return doc[:0], doc[:0]
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        hit = self.sorted[at] == hashes
        return doc[hit], self.place[at[hit]]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sums(x: np.ndarray, bounds: np.ndarray, n: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of rows with the features x[bounds[i]:bounds[i + 1]], n times each: the gradient of the summed sigmoid, the bias's place
    and the sum itself last. w holds the weights, then the bias."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), sizes)
    s = sigmoid(np.bincount(row, w[x], len(n)) + w[-1])
    slope = n * s * (1 - s)
    return np.concatenate([np.bincount(x, slope[row], len(w) - 1), [slope.sum(), (n * s).sum()]])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a column of lists without nulls."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


def over_all(patterns: DataFrame, w: np.ndarray) -> np.ndarray:
    """`sums` over all unlabelled rows: each task adds up its own and hands on one number a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(w) + 1)
        for batch in batches:
            total += sums(*lists(batch.column(0)), batch.column(1).to_numpy().astype(float), w)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["place", "x"])

    found = patterns.select("x", "n").mapInArrow(run, "place int, x double").groupBy("place").agg(F.sum("x").alias("x")).toPandas()
    return np.bincount(found["place"], found["x"], len(w) + 1)


def fit(positive: tuple[np.ndarray, np.ndarray], patterns: DataFrame, n_u: int, prior: float, ratios: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Weights, then the bias, by Adam on the non-negative risk with the sigmoid loss, which is bounded; no step draws at random.

    It begins at a part of the log ratios. The steps are on features less their means over the unlabelled, so that weights
    and bias move apart; what is returned is for features as they are.
    """
    w = np.append(START * ratios, np.log(prior / (1 - prior)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    n_p = len(positive[1]) - 1
    plain = lambda: np.append(w[:-1], w[-1] - w[:-1] @ means)
    centred = lambda g: np.concatenate([g[:-2] - means * g[-2], g[-2:]])
    for step in range(1, STEPS + 1):
        p = centred(sums(*positive, np.ones(n_p), plain())) / n_p
        u = centred(over_all(patterns, plain())) / n_u
        rest = u - prior * p  # of the unlabelled risk, what the positives among them don't explain
        grad = (rest[:-1] - prior * p[:-1] if rest[-1] >= 0 else -rest[:-1]) + 1e-5 * w
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return plain()


def score(docs: DataFrame, labels: DataFrame, rows: Column, label: str = "toxic", most_positives: int = MOST_POSITIVES) -> DataFrame:
    """All rows of docs with score, the probability of being toxic. rows: which doc_ids may teach.

    The risk takes at most most_positives labelled positives; token counts and the unlabelled risk take every row that may teach.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y")).where(rows)
    shares = known.agg(F.avg("_y").alias("prior"), F.sum("_y").alias("n")).first()
    names = [c for c in docs.columns if c.lower() != "score"]
    fields = T.StructType([*(docs.schema[n] for n in names), T.StructField("score", T.DoubleType())])
    if not shares["n"]:
        return docs.select(*names, F.lit(0.0).alias("score"))
    prior = min(0.99, float(shares["prior"]))
    positives = known.where("_y = 1").select("doc_id", F.lit(1).alias("_p"))
    if shares["n"] <= SMALL_IDS:
        positives = F.broadcast(positives)
    marked = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & rows).join(positives, "doc_id", "left")
    texts = marked.select("doc_id", F.lower("text").alias("text"), F.coalesce("_p", F.lit(0)).alias("y"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            y = batch.column(1).to_numpy()
            for lo, hi in pieces(offs):
                doc, hashes = distinct_tokens(data, offs[lo : hi + 1])
                token, place = np.unique(hashes, return_inverse=True)
                p = np.bincount(place, y[lo:hi][doc], len(token)).astype(np.int64)
                u = np.bincount(place, minlength=len(token)) - p
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(p), pa.array(u.astype(np.int64))], ["token", "p", "u"])

    n = texts.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p"), F.count_if(F.col("y") == 0).alias("u")).first()
    if not n["p"] or not n["u"]:
        return docs.select(*names, F.lit(0.0).alias("score"))
    n_p, n_u = n["p"], n["u"]
    table = texts.select("text", "y").mapInArrow(counted, "token long, p long, u long").groupBy("token").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # log ratio of the shares, weighed by the positives' share
    lift = F.col("p") / n_p * F.log(((F.col("p") + 0.5) / n_p) / ((F.col("u") + 0.5) / n_u))
    top = table.where(F.col("p") >= max(2, LEAST_SHARE * n_p)).select("token", "p", "u", lift.alias("lift")).orderBy(F.desc("lift"), "token").limit(FEATURES).toPandas()
    features = Features(top["token"].to_numpy(np.int64).view(np.uint64))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for lo, hi in pieces(offs):
                doc, feature = features(data, offs[lo : hi + 1])
                order = np.lexsort((feature, doc))
                bounds = np.searchsorted(doc[order], np.arange(hi - lo + 1))
                x = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(feature[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), x], ["doc_id", "y", "x"])

    # the positives keep their ids, so that a bounded number of them can be chosen; the others meet by their features
    held = texts.select("text", "doc_id", "y").mapInArrow(found, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("y int, x array<int>")]))
    taught = save(held.select("x", F.when(F.col("y") == 1, F.col("doc_id")).alias("doc_id")).groupBy("x", "doc_id").agg(F.count("*").alias("n")), "taught")
    patterns = taught.where("doc_id is null").select("x", "n")
    chosen = taught.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(most_positives).select("x").toPandas()["x"]
    positive = np.concatenate([*chosen, np.zeros(0, int)]).astype(int), np.concatenate([[0], np.cumsum([len(x) for x in chosen])]).astype(int)
    ratios = np.log(((top["p"] + 0.5) / n_p) / ((top["u"] + 0.5) / n_u)).to_numpy(float)
    learned = fit(positive, patterns, n_u, prior, ratios, (top["u"] / n_u).to_numpy(float))
    weights, bias = learned[:-1], float(learned[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("_folded"))
            z = np.full(batch.num_rows, bias)
            for lo, hi in pieces(offs):
                doc, feature = features(data, offs[lo : hi + 1])
                z[lo:hi] += np.bincount(doc, weights[feature], hi - lo)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*names, "score"])

    return docs.select(*names, F.lower("text").alias("_folded")).mapInArrow(run, fields)
