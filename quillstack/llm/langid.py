"""Language identification by mixture inference.

Each language is a distribution over hashed letter trigrams, counted over all learnable documents. A document is a
mixture of languages: expectation-maximisation estimates its proportions, and the set of languages is the one with the
best penalised likelihood among the nested sets that the full fit ranks.

Defined results: null text and text without a letter are `und` with score 0; rows with null lang teach nothing but are
predicted; repeated rows are predicted alike; with nothing to learn from every row is `und`; columns of the input that
have the names of the results are replaced; all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import pieces, utf8

BITS = 15
BUCKETS = 1 << BITS
MAX_LANGUAGES = 512
ROUNDS = 8
PENALTY = 6.0
NAMES = ("lang_pred", "score", "languages")
LETTERS = np.zeros(256, bool)
LETTERS[ord("a") : ord("z") + 1] = True
LETTERS[0x80:] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


@dataclass
class LanguageModel:
    languages: list[str]
    log_probs: np.ndarray  # (BUCKETS, languages), float32


def folded(body: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 in lower case."""
    out = FOLD[body]
    capital = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)) + 1
    out[capital] += 0x20
    return out


def trigrams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each trigram of letters, capitals folded; other characters count as one space, and ends too."""
    rows = len(offs) - 1
    start = offs[:-1] - offs[0]
    body = folded(data[offs[0] : offs[-1]])
    keep = np.insert(body, start, 32)  # a space before each document
    doc = np.repeat(np.arange(rows), np.diff(offs) + 1)
    letter = LETTERS[keep]
    chars = np.where(letter, keep, np.uint8(32))
    stay = letter.copy()
    stay[1:] |= letter[:-1]  # the first character after a letter ends the word
    stay[start + np.arange(rows)] = True
    stay[1:] &= ~((~letter[1:]) & (doc[1:] == doc[:-1]) & ~letter[:-1])
    chars, doc = np.append(chars[stay], np.uint8(32)).astype(np.uint32), np.append(doc[stay], rows)  # a space after all
    if len(chars) < 3:
        return doc[:0], chars[:0]
    code = (chars[:-2] << np.uint32(16)) | (chars[1:-1] << np.uint32(8)) | chars[2:]
    inside = (doc[:-2] == doc[1:-1]) & (chars[1:-1] != 32)
    inside &= (doc[2:] == doc[:-2]) | (chars[2:] == 32)  # the next document's first space ends the word as well
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return doc[:-2][inside], bucket[inside]


def learnable(mod: int = 3, held: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod != held, F.lit(False))


def fit(docs: DataFrame, rows: Column | None = None) -> LanguageModel:
    """Counts trigrams by language over all rows that `rows` admits and whose lang is not null."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.where(rows) if rows is not None else known
    names = [r[0] for r in known.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    names.sort()
    code = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            data, offs = utf8(batch.column(0))
            lang = np.array([code[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi in pieces(offs):
                doc, bucket = trigrams(data, offs[lo : hi + 1])
                of = lang[lo:hi][doc]
                for k in np.unique(of):
                    sums[k] = sums.get(k, 0) + np.bincount(bucket[of == k], minlength=BUCKETS)
        for k, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(v[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = known.select("text", "lang").mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(names)))
    counts[rows["bucket"].to_numpy(int), rows["lang"].to_numpy(int)] = rows["n"].to_numpy(float)
    return LanguageModel(names, np.log((counts + 0.1) / (counts.sum(0) + 0.1 * BUCKETS)).astype(np.float32))


def proportions(probs: np.ndarray, count: np.ndarray, start: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for many documents at once, a row for each language: (proportions, log-likelihoods)."""
    width = np.diff(np.append(start, probs.shape[1]))
    for _ in range(rounds):
        part = np.repeat(pi, width, axis=1)
        part *= probs
        part *= count / part.sum(0)
        pi = np.add.reduceat(part, start, axis=1)
        pi /= pi.sum(0)
    part = np.repeat(pi, width, axis=1)
    part *= probs
    return pi, np.add.reduceat(count * np.log(part.sum(0)), start)


def infer(model: LanguageModel, doc: np.ndarray, bucket: np.ndarray, rows: int, penalty: float) -> np.ndarray:
    """Proportions by document; a document without trigrams has zeros."""
    k = len(model.languages)
    out = np.zeros((rows, k))
    if not len(doc) or not k:
        return out
    key = np.sort((doc.astype(np.uint64) << np.uint64(BITS)) | bucket.astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key))).astype(np.float32)
    key = key[first]
    at, logs = (key >> np.uint64(BITS)).astype(np.int64), model.log_probs.T[:, (key & np.uint64(BUCKETS - 1)).astype(np.int64)]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ids, of = at[start], np.repeat(np.arange(len(start)), np.diff(np.append(start, len(at))))
    total = np.add.reduceat(count, start)
    alone = np.add.reduceat(count * logs, start, axis=1)
    best, chosen = alone.max(0), np.eye(k)[alone.argmax(0)]
    if k > 1:
        probs = np.exp(logs)
        full, reach = proportions(probs, count, start, np.full((k, len(start)), 1.0 / k, np.float32), ROUNDS)
        order = np.argsort(-full.T, axis=1, kind="stable")
        cost = penalty * np.log1p(total)
        open_ = np.flatnonzero(reach - best > cost)  # no set can gain more than the full one
    else:
        open_ = np.zeros(0, int)
    size = 2
    while len(open_) and size <= k:
        inner = np.isin(of, open_)
        inner_of = of[inner]
        inner_start = np.flatnonzero(np.concatenate([[True], inner_of[1:] != inner_of[:-1]]))
        pi = np.zeros((len(open_), k), np.float32)
        np.put_along_axis(pi, order[open_, :size], 1.0 / size, axis=1)
        pi, got = proportions(probs[:, inner], count[inner], inner_start, pi.T, ROUNDS)
        gain = got - best[open_] > cost[open_]
        won = open_[gain]
        chosen[won], best[won] = pi.T[gain], got[gain]
        open_ = won[reach[won] - best[won] > cost[won]]
        size += 1
    out[ids] = chosen
    return out


def predict(docs: DataFrame, model: LanguageModel, penalty: float = PENALTY, mixture: bool = True) -> DataFrame:
    """Adds lang_pred, score (the proportion of the main language) and, with `mixture`, languages (proportions of 0.01 or more).

    Only texts go to the Python workers, and only results come back.
    """
    clash = {n.lower() for n in NAMES}
    kept = [c for c in docs.columns if c.lower() not in clash]
    names = model.languages
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if mixture:
        kind = kind.add("languages", T.MapType(T.StringType(), T.DoubleType()))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, marks in batches:
            data, offs = utf8(text)
            letters = marks.to_numpy(zero_copy_only=False).astype(bool)
            lang, score, maps = [], [], []
            for lo, hi in pieces(offs):
                pi = infer(model, *trigrams(data, offs[lo : hi + 1]), hi - lo, penalty) if names else np.zeros((hi - lo, 1))
                good = letters[lo:hi] & (pi.sum(1) > 0)
                lang += [names[m] if g else "und" for m, g in zip(pi.argmax(1), good)]
                score.append(np.where(good, pi.max(1), 0.0))
                if mixture:
                    maps += [[(names[j], float(p[j])) for j in np.flatnonzero(p >= 0.01)] if g else [] for p, g in zip(pi, good)]
            arrays = [pa.array(lang, pa.string()), pa.array(np.concatenate([*score, np.zeros(0)]))]
            if mixture:
                arrays.append(pa.array(maps, pa.map_(pa.string(), pa.float64())))
            yield pa.StructArray.from_arrays(arrays, kind.names)

    found = "_found"
    while found in {c.lower() for c in kept}:
        found += "_"
    judge = F.arrow_udf(run, kind).asNondeterministic()  # so that filters on its results don't run it again
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(*kept, judge(F.col("text"), letters).alias(found)).select(*kept, f"{found}.*")
