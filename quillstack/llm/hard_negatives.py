"""Hard negatives by exact integer products, computed in a residue number system.

A score is the inner product of two integer vectors. Both are taken modulo a few small primes, centred around 0, and the
float32 products of the residues are exact as long as a sum of them stays under 2**24; longer vectors are cut into parts.
The residues of the score are joined to the score itself by mixed radix digits (Chinese remaindering); a bound on it is added
first, so that no sign is lost. How many primes a block takes follows from its largest numbers, whatever they are.

Anchors go to all tasks in blocks of about ANCHORS rows. A first pass over all rows keeps, in each task, the best
POSITIVES rows with an anchor's label, and a ranking of these few finds its positives; a second pass keeps, for each positive,
the best rows of other labels in the window that its score sets, and a second ranking ends it. A task ranks whole batches
and holds the best so far; rows are never shuffled, paired up or sampled. Rows of many like vectors only tie.

Defined results: rows with a null id or label, a null vector or a null or non-finite component take no part; vectors
of different lengths don't meet; of anchor rows that are equal in all three, one answers; rows that share an
anchor's id aren't its positives; other repeated rows each count; ties go to the smaller id, and whole numbers past 64 bits raise an error. Without
anchors, or without positives, there are no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import save

ANCHORS = 4096  # rows whose vectors go to every task at once
TOGETHER = 1 << 21  # scores held at once in a task
# Odd primes of which residues fit float32 products; the largest half squared, times PART, is under 2**24
PRIMES = (509, 503, 499, 491, 487, 479, 467, 463)
PART = (1 << 24) // (PRIMES[0] // 2) ** 2
MOST_BOUND = 1 << 61
Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, labels (codes) and whole numbers of rows with vectors of one length


def components(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, their components floor(256 x) end to end)."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    rows = np.flatnonzero(pc.is_valid(vectors).to_numpy(zero_copy_only=False))
    full = vectors.drop_null()
    flat, sizes = full.flatten(), pc.list_value_length(full).to_numpy(zero_copy_only=False).astype(np.int64)
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(sizes)
    good = bad[ends] == bad[ends - sizes]
    values = np.floor(256 * values[np.repeat(good, sizes)])
    if len(values) and np.abs(values).max() >= 1 << 53:
        raise ValueError("components over 2**53 have no exact whole number")
    return rows[good], sizes[good], values.astype(np.int64)


def blocks_of(batch: pa.RecordBatch | pa.Table, codes: dict) -> Iterator[Block]:
    """Blocks of one vector length of a batch (id, label, vector). codes: numbers of the labels that the anchors have; others are -1."""
    rows, sizes, values = components(batch.column(2))
    ends = np.cumsum(sizes)
    ids, labels = (batch.column(i).take(pa.array(rows)) for i in (0, 1))
    keep = pc.and_(pc.is_valid(ids), pc.is_valid(labels)).to_numpy(zero_copy_only=False)
    code = np.array([codes.get(x, -1) for x in labels.to_pylist()], np.int64)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for size in np.unique(sizes[keep]):
        own = np.flatnonzero(keep & (sizes == size))
        places = (ends[own] - size)[:, None] + np.arange(size)
        order = np.argsort(number[own], kind="stable")  # by id: a stable ranking by score then leaves ties in order
        yield number[own][order], code[own][order], values[places][order]


def residues(x: np.ndarray, prime: int) -> np.ndarray:
    half = prime // 2
    return ((x + half) % prime - half).astype(np.float32)


def product_mod(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """a @ b.T modulo a prime, from 0 on; sums of PART products are exact in float32."""
    out = np.zeros((len(a), len(b)), np.int64)
    for lo in range(0, a.shape[1], PART):
        out += (residues(a[:, lo : lo + PART], prime) @ residues(b[:, lo : lo + PART], prime).T).astype(np.int64)
    return out % prime


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: by as many primes as a bound on the result asks for."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = lambda x: max(abs(int(x.min())), abs(int(x.max())))
    ends = largest(a) * largest(b) * a.shape[1]
    if ends >= MOST_BOUND:  # a closer bound
        ends = int(np.abs(a).astype(object).sum(1).max()) * largest(b)
    if ends >= MOST_BOUND:
        raise ValueError("scores past 64 bits")
    total, step = np.zeros((len(a), len(b)), np.int64), 1
    digits: list[tuple[int, np.ndarray]] = []
    for prime in PRIMES:
        rest = (product_mod(a, b, prime) + ends) % prime
        weight = 1
        for p, digit in digits:  # what the digits so far come to, modulo this prime
            rest -= digit * (weight % prime)
            weight *= p
        rest %= prime
        rest *= pow(weight, -1, prime)
        rest %= prime
        total += rest * step
        digits.append((prime, rest))
        step *= prime
        if step > 2 * ends:
            return total - ends
    raise ValueError("scores past 64 bits")


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, in order; of equal ones the first."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
        return at[np.argsort(-scores[at], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def merged(held: tuple[np.ndarray, np.ndarray] | None, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if held is not None:
        ids, scores = np.append(held[0], ids), np.append(held[1], scores)
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


Found = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]
Take = Callable[[Found, int, np.ndarray, np.ndarray, np.ndarray], None]


def scan(rows: DataFrame, table: pa.Table, take: Take, name: str) -> DataFrame:
    """(anchor, slot, id, score): what `take` keeps in each task, of each anchor's scores with the task's rows.

    table: the anchors (id, label, vector). take(found, anchor, ids, labels that are the anchor's, scores); ids in order.
    """
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        codes = {x: i for i, x in enumerate(sorted(set(anchors.column(1).to_pylist())))}
        rows_, sizes, values = components(anchors.column(2))
        labels = np.array([codes[x] for x in anchors.column(1).to_pylist()], np.int64)
        starts = np.cumsum(sizes) - sizes
        by_size = {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes)}
        vectors = {s: values[starts[own][:, None] + np.arange(s)] for s, own in by_size.items()}
        found: Found = {}
        for batch in batches:
            for ids, code, numbers in blocks_of(batch, codes):
                own = by_size.get(numbers.shape[1], np.zeros(0, np.int64))
                step = max(1, TOGETHER // max(1, len(ids)))
                for lo in range(0, len(own), step):
                    scores = exact_products(vectors[numbers.shape[1]][lo : lo + step], numbers)
                    for at, line in zip(own[lo : lo + step].tolist(), scores):
                        take(found, at, ids, code == labels[at], line)
        keys = np.array(list(found), np.int64).reshape(-1, 2)
        counts = [len(i) for i, _ in found.values()]
        lists = [np.concatenate([x[j] for x in found.values()]) if found else np.zeros(0, np.int64) for j in (0, 1)]
        columns = [np.repeat(keys[:, 0], counts), np.repeat(keys[:, 1], counts), *lists]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["anchor", "slot", "id", "score"])

    return save(rows.mapInArrow(run, "anchor long, slot long, id long, score long"), name)


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `anchor` holds for.

    rows (vec_id, label, embedding). An anchor's positives are its best other rows of the same label; a positive's negatives the
    best rows of other labels whose score is from low to high percent of its own.
    """
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", F.coalesce(anchor, F.lit(False)).alias("_anchor"))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = save(rows.where(F.col("_anchor") & whole).select("vec_id", "label", "embedding").distinct(), "anchors")
    rows = rows.select("vec_id", "label", "embedding")
    blocks = asked.count() // ANCHORS + 1
    block = F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(blocks))
    parts = [of_block(rows, asked.where(block == b).toArrow(), positives, negatives, low, high) for b in range(blocks)]
    return reduce(DataFrame.union, parts)


def of_block(rows: DataFrame, table: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The answers of about ANCHORS anchors."""
    own_ids = table.column(0).to_pylist()

    def alike(found: Found, at: int, ids: np.ndarray, same: np.ndarray, scores: np.ndarray) -> None:
        mine = np.flatnonzero(same & (ids != own_ids[at]))
        top = mine[best(scores[mine], positives)]
        if len(top):
            found[at, 0] = merged(found.get((at, 0)), ids[top], scores[top], positives)

    slots: dict[int, list[tuple[int, int, int]]] = {}
    chosen = []
    for r in ranked(scan(rows, table, alike, "positives"), positives).collect():  # at most `positives` for each anchor of the block
        least, most = -(-low * r["score"] // 100), high * r["score"] // 100
        chosen.append((r["anchor"], r["rank"], own_ids[r["anchor"]], r["id"], r["score"]))
        if least <= most:
            slots.setdefault(r["anchor"], []).append((r["rank"], least, most))

    def unlike(found: Found, at: int, ids: np.ndarray, same: np.ndarray, scores: np.ndarray) -> None:
        windows = slots.get(at, ())
        if not windows:
            return
        other = np.flatnonzero(~same & (scores >= min(w[1] for w in windows)) & (scores <= max(w[2] for w in windows)))
        other = other[np.argsort(-scores[other], kind="stable")]
        falling = -scores[other]
        for slot, least, most in windows:
            top = other[np.searchsorted(falling, -most) :][:negatives]
            top = top[scores[top] >= least]
            if len(top):
                found[at, slot] = merged(found.get((at, slot)), ids[top], scores[top], negatives)

    names = rows.sparkSession.createDataFrame(chosen, "anchor long, slot long, anchor_id long, positive_id long, positive_score long")
    last = ranked(scan(rows, table, unlike, "negatives"), negatives)
    joined = last.join(F.broadcast(names), ["anchor", "slot"])  # about ANCHORS times `positives` rows
    return joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
