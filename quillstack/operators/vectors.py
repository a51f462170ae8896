"""Hashes and vectors: digests, feature hashing, indexes and top-k search."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.readers import audit_rows
from .gate import bounded, live_only, passed
from .search import free_text
from .tagging import dot, unit

MEGABYTE = 1 << 20
MOST_QUERIES = 10_000
# Weights of the kinds of vectors
TOPK_WEIGHTS = {"image": 1.0}
SEARCH_WEIGHTS = {"image": 1.15, "text": 1.0, "tag": 0.9, "transcript": 1.05, "frame": 1.1}


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def hash8(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def partial_hash(content: Column) -> Column:
    """SHA-256 of the first megabyte, of the last one too if there are over two, and of the size."""
    size = F.octet_length(content)
    parts = F.concat(F.substring(content, 1, MEGABYTE), F.when(size > 2 * MEGABYTE, F.substring(content, -MEGABYTE, MEGABYTE)).otherwise(F.lit("").cast("binary")), size.cast("string").cast("binary"))
    return F.sha2(parts, 256)


def dhash_bits(luma: Column) -> Column:
    """64 comparisons left > right of a 9 x 8 grid, as 16 hexadecimal digits; null unless there are 72 values."""
    nibble = lambda n: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0), lambda a, b: a * 2 + F.when(F.get(luma, ((n * 4 + b) / 8).cast("int") * 9 + F.pmod(n * 4 + b, F.lit(8))) > F.get(luma, ((n * 4 + b) / 8).cast("int") * 9 + F.pmod(n * 4 + b, F.lit(8)) + 1), 1).otherwise(0))
    return F.when(F.size(luma) == 72, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda n: F.lower(F.hex(nibble(n).cast("long")))), ""))


def hash_bits_vector(digest: Column) -> Column:
    """The 64 bits of 16 hexadecimal digits as plus or minus 1/8."""
    bits = lambda i: F.pmod(F.floor(F.conv(F.substr(digest, F.floor(i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int") / F.pow(F.lit(2), 3 - F.pmod(i, F.lit(4)))).cast("int"), F.lit(2))
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(bits(i) == 1, 0.125).otherwise(-0.125))


KNOWN = 200_000  # tokens whose place a task remembers
WORD = r"[\w-]+"  # letters and digits of all scripts, and _


def token_place(token: str, dim: int) -> int:
    """2 * bucket, plus 1 for a minus: the bucket by the first four bytes of the MD5, the sign by the fifth."""
    digest = hashlib.md5(token.encode()).digest()
    return 2 * (int.from_bytes(digest[:4], "big") % dim) + (1 - digest[4] % 2)


def row_vectors(rows: DataFrame, column: str, name: str, dim: int, words_of: Callable[[object], list[str]], token_of: Callable[[str], str | None]) -> DataFrame:
    """Rows with a vector in place of a column, made within the row; those without tokens go.

    The words of a row are counted first, so that each distinct one is looked up once; token_of gives its token, or None.
    """
    kept = [c for c in rows.columns if c not in (column, name)]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}  # -1: no token

        def place(word: str) -> int:
            token = token_of(word)
            return known.setdefault(word, -1 if token is None else token_place(token, dim))

        for batch in batches:
            at, found = [], []
            for i, value in enumerate(batch.column(len(kept))):
                counts = Counter(words_of(value.as_py()))
                if len(known) > KNOWN:
                    known.clear()
                places = np.array([known[w] if w in known else place(w) for w in counts], np.int64)
                if not len(places) or places.max() < 0:
                    continue
                sums = np.bincount(places + 1, np.fromiter(counts.values(), float, len(counts)), 2 * dim + 1)[1:]
                vector = sums[0::2] - sums[1::2]
                norm = np.sqrt(np.dot(vector, vector))
                at.append(i)
                found.append(vector / norm if norm else vector)
            columns = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(kept))]
            flat = pa.array(np.concatenate(found) if found else np.zeros(0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * dim, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*columns, lists], [*kept, name])

    return rows.select(*kept, column).mapInArrow(run, schema)


def hashed_text_vector(rows: DataFrame, tokens: str, key: str, dim: int = 128) -> DataFrame:
    """(key, vector): signed feature hashing of a column of tokens by MD5, unit length; zeros if the signs cancel out.

    A vector for each row, made in the row's own task without a shuffle; null tokens and rows without any have none.
    """
    return row_vectors(rows.select(key, tokens), tokens, "vector", dim, lambda words: [w for w in words or () if w is not None], lambda word: word)


def hashed_texts(rows: DataFrame, text: str = "text", dim: int = 128) -> DataFrame:
    """rows with a vector of the words of a text (as texts.semantic_tokens has them) in its place; rows without words go."""
    word = re.compile(WORD)

    def token_of(raw: str) -> str | None:
        token = raw.strip("_-")[:48]
        return token if len(token) >= 2 else None

    return row_vectors(rows.withColumn(text, F.lower(text)), text, "vector", dim, lambda body: word.findall(body or ""), token_of)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashed_text_vector_blake2b(tokens: pd.Series) -> pd.Series:
    """The same with 8-byte BLAKE2b digests, where these are asked for; 128 places."""

    def one(words: np.ndarray | None) -> list[float]:
        out = np.zeros(128)
        for w in [] if words is None else words:
            d = hashlib.blake2b(w.encode(), digest_size=8).digest()
            out[int.from_bytes(d[:4], "big") % 128] += 1.0 if d[4] & 1 else -1.0
        norm = np.linalg.norm(out)
        return (out / norm if norm else out).tolist()

    return tokens.map(one)


@F.pandas_udf(T.BinaryType())
def pack_vector(vector: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats; no bytes for a null or empty vector."""
    return vector.map(lambda v: b"" if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_vector(blob: pd.Series, dim: pd.Series) -> pd.Series:
    """The first dim floats; an empty vector where there are fewer, or no bytes, or no positive dim."""
    whole = [(b, 0 if pd.isna(d) else int(d)) for b, d in zip(blob, dim)]
    return pd.Series([np.frombuffer(b, "<f4", d).tolist() if b and d > 0 and len(b) >= 4 * d else [] for b, d in whole], dtype=object)


def placed_vectors(items: DataFrame, rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows with item_id and outcome: imported, skipped (in done) or failed (a broken line, no vector, a bad component, no gated item)."""
    own = passed(items).where("path is not null").groupBy("path").agg(F.min("item_id").alias("item_id"))
    good = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    known = done.select("item_id", "model").distinct().withColumn("_done", F.lit(True))
    placed = rows.withColumn("_good", F.coalesce(good, F.lit(False))).join(own, rows["media_path"] == own["path"], "left").drop("path").join(known, ["item_id", "model"], "left")
    state = F.when(~F.col("_good") | F.col("item_id").isNull(), "failed").when(F.col("_done"), "skipped").otherwise("imported")
    return placed.withColumn("outcome", state).drop("_good", "_done")


def import_vectors(items: DataFrame, rows: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new vectors of unit length, counts): rows (media_path, model, embedding) join gated items (path, item_id); those in done (item_id, model) are skipped."""
    placed = placed_vectors(items, rows, done)
    return new_vectors(placed), placed.groupBy("outcome").agg(F.count("*").alias("rows"))


def new_vectors(placed: DataFrame) -> DataFrame:
    return placed.where("outcome = 'imported'").select("item_id", "model", unit(F.col("embedding").cast("array<double>")).alias("vector"))


def import_vectors_into(items: DataFrame, rows: DataFrame, done: DataFrame, folder: str, audit: str) -> dict[str, int]:
    """Appends the new vectors to a table and an audit row to another; the counts by outcome come from that one write.

    rows as readers.read_vectors_jsonl(broken=True) has them, so that broken lines count as failed.
    """
    seen = Observation()
    outcomes = ("imported", "skipped", "failed")
    placed = placed_vectors(items, rows, done).observe(seen, *(F.count_if(F.col("outcome") == x).alias(x) for x in outcomes))
    new_vectors(placed).write.mode("append").parquet(folder)
    counts = {x: int(seen.get[x]) for x in outcomes}
    detail = " ".join(f"{k}={v}" for k, v in counts.items())
    audit_rows(rows.sparkSession, "import_vectors", sum(counts.values()), detail).write.mode("append").parquet(audit)
    return counts


def vector_index(items: DataFrame, texts: DataFrame, done: DataFrame, model: str, dim: int = 128) -> DataFrame:
    """texts (item_id, kind, text) of gated items -> (item_id, kind, model, text_hash, vector), only where the text or the model changed since done.

    The texts of the items that are new are hashed in place: no shuffle but that of the two joins by id.
    """
    hashed = live_only(texts.select("item_id", "kind", "text"), items).where("length(text) > 0").select("item_id", "kind", F.lit(model).alias("model"), F.sha2("text", 256).alias("text_hash"), "text")
    keys = ["item_id", "kind", "model", "text_hash"]
    fresh = hashed.join(done.select(keys).distinct(), keys, "left_anti").select(*keys, "text")
    return hashed_texts(fresh, "text", dim).select(*keys, "vector")


def top_products(base: DataFrame, queries: DataFrame, k: int, weights: dict[str, float], other: float, cut: bool = False) -> DataFrame:
    """(query_id, item_id, score): the k best items of each query by weighted dot product, over vectors of one kind and model.

    queries (query_id, kind, model, vector) go to every task in blocks of about MOST_QUERIES rows; each task keeps its
    own k best of each query, and only these meet in a final ranking. cut: vectors of unequal length are cut to the
    shorter one, else they don't meet.
    """
    queries = queries.select("query_id", "kind", "model", "vector")
    blocks = queries.count() // MOST_QUERIES + 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    local = reduce(DataFrame.union, (local_products(base, queries.where(block == b), k, weights, other, cut) for b in range(blocks)))
    own = local.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("item_id")))
    return own.where("query_id <> item_id").withColumn("rank", rank).where(F.col("rank") <= k)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k items with the best scores, each with its best one; of equal scores those with the larger ids."""
    order = np.lexsort((-ids, -scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


def local_products(base: DataFrame, queries: DataFrame, k: int, weights: dict[str, float], other: float, cut: bool) -> DataFrame:
    """(query_id, item_id, score): the k + 1 best items of each query within each task of base."""
    groups: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    found: dict[tuple, list] = {}
    for r in queries.collect():  # about MOST_QUERIES rows
        found.setdefault((r["kind"], r["model"], len(r["vector"])), []).append((r["query_id"], r["vector"]))
    for key, rows in found.items():
        groups[key] = np.array([q for q, _ in rows], np.int64), np.array([v for _, v in rows], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            pdf = batch.to_pandas()
            for (kind, model), part in pdf.groupby(["kind", "model"], sort=False):
                sizes = part["vector"].map(len)
                for n, same in part.groupby(sizes, sort=False):
                    matrix = np.stack(same["vector"].to_numpy()).astype(np.float64)
                    ids = same["item_id"].to_numpy()
                    for (q_kind, q_model, q_size), (names, asked) in groups.items():
                        if (q_kind, q_model) != (kind, model) or not cut and q_size != n:
                            continue
                        m = min(n, q_size)
                        for lo in range(0, len(names), 256):  # the products of 256 queries are held at once
                            scores = matrix[:, :m] @ asked[lo : lo + 256, :m].T * weights.get(kind, other)
                            for qid, own in zip(names[lo : lo + 256].tolist(), scores.T):
                                held = best.get(qid, (ids[:0], own[:0]))
                                best[qid] = best_of(np.append(held[0], ids), np.append(held[1], own), k + 1)
        columns = [np.repeat(list(best), [len(i) for i, _ in best.values()]).astype(np.int64), *(np.concatenate([x[j] for x in best.values()]) for j in (0, 1))] if best else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "item_id", "score"])

    return base.select("item_id", "kind", "model", "vector").mapInArrow(run, "query_id long, item_id long, score double")


def cosine_topk(items: DataFrame, vectors: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k gated items most like each base vector (query_id is its item_id): image vectors weigh 1, others 0.75; not itself."""
    live = vectors.join(passed(items).select("item_id"), "item_id", "left_semi")
    return top_products(live, base, k, TOPK_WEIGHTS, 0.75, cut=True)


def semantic_search(
    items: DataFrame, vectors: DataFrame, query: DataFrame, texts: DataFrame, k: int, prefer: tuple[str, ...] = (), must: tuple[str, ...] = (), exclude: tuple[str, ...] = (), tag: str | None = None, tags: DataFrame | None = None, least: float = 0.16
) -> DataFrame:
    """(item_id, score): weighted dot product plus bonuses for terms that the caller gives, for one query (kind, model, vector).

    Bonus up to 0.28 for preferred and up to 0.36 for required terms, by their share, and 0.08 for the tag; items must have
    all required and no excluded terms, and score `least` or more; the best vector of an item counts.
    """
    live = vectors.join(passed(items).select("item_id"), "item_id", "left_semi")
    weight = F.coalesce(*(F.when(F.col("kind") == n, w) for n, w in SEARCH_WEIGHTS.items()), F.lit(1.0))
    q = bounded(query, 1, "query row").select(F.col("model").alias("_model"), F.col("vector").alias("_q"))
    met = live.join(F.broadcast(q), (F.col("model") == F.col("_model")) & (F.size("vector") == F.size("_q"))).select("item_id", (dot(F.col("vector"), F.col("_q")) * weight).alias("s"))
    best = met.groupBy("item_id").agg(F.max("s").alias("s")).join(texts.select("item_id", F.lower("text").alias("_text")), "item_id", "left")
    share = lambda terms: sum((F.when(F.contains("_text", F.lit(t.lower())), 1.0).otherwise(0.0) for t in terms), F.lit(0.0)) / max(1, len(terms))
    for t in must:
        best = best.where(F.contains("_text", F.lit(t.lower())))
    for t in exclude:
        best = best.where(~F.coalesce(F.contains("_text", F.lit(t.lower())), F.lit(False)))
    score = F.col("s") + 0.28 * share(prefer) + 0.36 * share(must)
    if tag and tags is not None:
        has = tags.where((F.col("tag") == tag) & (F.col("state") != "rejected")).select("item_id").distinct().withColumn("_tag", F.lit(0.08))
        best = best.join(has, "item_id", "left")
        score = score + F.coalesce("_tag", F.lit(0.0))
    return best.select("item_id", score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), F.desc("item_id")).limit(k)


def search_or_text(found: DataFrame, items: DataFrame, tags: DataFrame, transcripts: DataFrame, text: str, k: int) -> DataFrame:
    """Ids of a search, or, where it found nothing, of the free-text filter, newest first."""
    if not found.isEmpty():
        return found.select("item_id")
    return free_text(passed(items), tags, transcripts, text, ["filename", "path"]).orderBy(F.desc("mtime"), F.desc("item_id")).limit(k).select("item_id")
