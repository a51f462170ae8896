"""Mixing sources to target weights by blocks of words.

Each source's documents are laid end to end and cut into blocks of a fixed number of words. Each output shard draws how
many of its slots go to each source from a multinomial distribution, and these draws decide how much of a source the mix
takes; the running counts number a source's slots. Only where the draws of a small source leave it further than NEAR from its
target, slots beyond are left out or shards get some more in turn, and none is used beyond LIMIT epochs. Slot j of a source
with B blocks takes block P_e(j mod B), where P_e is the pseudorandom permutation (a keyed Feistel network with cycle walking)
of epoch e = j div B. Blocks are joined by index: `mix_spans` gives the spans of documents that each shard holds, and
`mix_sources` counts their words back to documents.

Weights: sources by code point, null last, weigh 1, 2, 3, repeating, and share all words; a target stops at three times
its source's size and the rest is shared by weight among the others until none is above.

Defined results: null or empty texts have size 0 and are never taken; rows with a null doc_id are mixed like others;
repeated rows are rows of their own; an empty table gives an empty result; all draws depend on SEED only, so that
reruns agree; columns of the input pass through unless they have the names of results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import save
from .textbytes import mix

BLOCK_WORDS = 128
SEED = 17
LIMIT = 3
NEAR = 0.02  # share of a source's slots that its draws may leave it off its target
CHUNKS, CHUNK_ROWS = 256, 50_000  # fewest parts of a source whose words are summed apart, and rows for which there is one more
GROUP = 1024  # parts that are summed together
MAX_SOURCES = 100_000
MAX_SHARDS = 65_536
FILL_SLOTS, MOST_FILLS = 1 << 17, 8192  # slots that a task maps to blocks, and most tasks for it
SHARD_SLOTS = 1024
NAMES = ("size", "source_size", "target", "taken")


def size_of(text: Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in a text."""
    return F.coalesce(F.size(F.array_remove(F.split(text, "[ \\x09-\\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], limit: int = LIMIT) -> list[float]:
    """Shares of all words by weight, none above `limit` times its source's size."""
    out = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def permuted(index: np.ndarray, count: np.ndarray, key: np.ndarray) -> np.ndarray:
    """P_key(index) on 0..count-1, element by element: a Feistel network over the next even power of two, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m = half[todo], low[todo]
        left, right = x[todo] >> h, x[todo] & m
        for turn in range(4):
            left, right = right, left ^ (mix(right * np.uint64(0x9E3779B97F4A7C15) + key[todo] + np.uint64(turn)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= count[todo].astype(np.uint64)]
    return x.astype(np.int64)


def starts(chunks: DataFrame) -> DataFrame:
    """(source, chunk, words) with start, the words of the source before each chunk: sums within groups of chunks, and of whole groups."""
    chunks = save(chunks.withColumn("part", F.expr(f"chunk div {GROUP}")), "chunks")
    groups = chunks.groupBy("source", "part").agg(F.sum("words").alias("base"))
    groups = groups.select(F.col("source").alias("_source"), F.col("part").alias("_part"), F.expr("sum(base) over (partition by source order by part) - base").alias("base"))
    within = chunks.withColumn("start", F.expr("sum(words) over (partition by source, part order by chunk) - words"))
    both = within.join(groups, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    return save(both.select("source", "chunk", "words", (F.col("base") + F.col("start")).alias("start")), "starts")


def laid_out(docs: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """Rows with their size and chunk; (source, chunk, words, start); a row (source, words) for each source, by code point, null last."""
    place = F.xxhash64("doc_id", F.col("text")).alias("place")
    parts = save(docs.select(F.col("doc_id"), "source", F.xxhash64("text").alias("mark"), place, size_of(F.col("text")).alias("size")), "sizes")
    chunks = max(CHUNKS, parts.count() // CHUNK_ROWS)
    parts = parts.withColumn("chunk", F.pmod("place", F.lit(chunks))).drop("place")
    totals = starts(parts.groupBy("source", "chunk").agg(F.sum("size").alias("words")))
    found = totals.groupBy("source").agg(F.sum("words").alias("words")).limit(MAX_SOURCES + 1).collect()  # a row for each source
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources")
    return parts, totals, sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))


def source_table(spark: SparkSession, found: list) -> tuple[DataFrame, list[float]]:
    """(code, name, source_size, target) of the sources, and their targets."""
    goals = targets([r["words"] for r in found], [1 + i % 3 for i in range(len(found))])
    rows = [(i, r["source"], r["words"], float(g)) for i, (r, g) in enumerate(zip(found, goals))]
    return spark.createDataFrame(rows, "code int, name string, source_size long, target double"), goals


def mixed_blocks(spark: SparkSession, sizes: list[int], goals: list[float], block_words: int, seed: int) -> DataFrame:
    """(shard, code, slot, block): the mix. The slots of a source, numbered through its shards, and the block that each takes."""
    blocks = np.array([-(-s // block_words) for s in sizes], np.int64)
    # whole epochs take every word; the remainder is in blocks of an average size
    slots = np.array([min(LIMIT * b, int(round(g * b / s))) if s else 0 for s, g, b in zip(sizes, goals, blocks)], np.int64)
    total = int(slots.sum())
    shards = min(MAX_SHARDS, -(-total // SHARD_SLOTS)) if total else 0
    each = -(-total // shards) if shards else 0
    share = slots / max(total, 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                count = np.random.Generator(np.random.Philox([seed, shard])).multinomial(min(each, total - shard * each), share)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(at.astype(np.int32)), pa.array(count[at])], ["shard", "code", "n"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, code, first, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "code", "first", "n"))):
                for lo in range(first, first + n, 1 << 16):
                    j = np.arange(lo, min(first + n, lo + (1 << 16)), dtype=np.int64)
                    key = mix((j // blocks[code]).astype(np.uint64) + np.uint64((seed << 40) + (code << 8)))
                    block = permuted(j % blocks[code], np.full(len(j), blocks[code]), key)
                    own = (j + code) % shards if shard is None else np.full(len(j), shard)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(j), code, np.int32)), pa.array(j), pa.array(block)], ["shard", "code", "slot", "block"])

    drawn = spark.range(0, max(shards, 0), numPartitions=max(1, min(shards, 64 + shards // 64))).mapInArrow(draw, "shard long, code int, n long")
    drawn = drawn.withColumn("first", F.expr("sum(n) over (partition by code order by shard) - n"))
    drawn = save(drawn, "draws")
    bounds = [(i, int(s * (1 - NEAR)), min(LIMIT * int(b), int(np.ceil(s * (1 + NEAR))))) for i, (s, b) in enumerate(zip(slots.tolist(), blocks))]
    bounds = spark.createDataFrame(bounds, "code int, fewest long, most long")
    sums = drawn.groupBy("code").agg(F.sum("n").alias("drawn"))
    kept = drawn.join(F.broadcast(bounds), "code").select("shard", "code", "first", F.expr("least(n, most - first)").alias("n")).where("n > 0")
    topped = bounds.join(sums, "code", "left").select(F.lit(None).cast("long").alias("shard"), "code", F.coalesce("drawn", F.lit(0)).alias("first"), F.expr("fewest - coalesce(drawn, 0)").alias("n")).where("n > 0")
    tasks = min(MOST_FILLS, 1 + total // FILL_SLOTS)  # a number, as AQE would put these short rows, which stand for many slots, into one task
    return kept.union(topped).repartition(tasks, F.col("code"), F.col("first")).mapInArrow(fill, "shard long, code int, slot long, block long")


def pieces_of(parts: DataFrame, totals: DataFrame, sources: DataFrame, block_words: int) -> DataFrame:
    """(doc_id, source, mark, copy, code, block, first_word, words): what each block holds of each document."""
    placed = parts.where("size > 0").join(totals.withColumnRenamed("start", "base"), [parts["source"].eqNullSafe(totals["source"]), parts["chunk"] == totals["chunk"]]).select(parts["doc_id"], parts["source"], "mark", parts["chunk"], "size", "base")
    placed = placed.withColumn("begin", F.expr("base + sum(size) over (partition by source, chunk order by doc_id, mark rows unbounded preceding) - size"))
    placed = placed.withColumn("copy", F.expr("row_number() over (partition by doc_id, source, mark order by begin)"))
    placed = placed.join(F.broadcast(sources), placed["source"].eqNullSafe(sources["name"])).select("doc_id", "source", "mark", "copy", "code", "size", "begin")
    pieces = placed.select("doc_id", "source", "mark", "copy", "code", "begin", (F.col("begin") + F.col("size")).alias("end"), F.explode(F.expr(f"sequence(begin div {block_words}, (begin + size - 1) div {block_words})")).alias("block"))
    first = F.expr(f"greatest(begin, block * {block_words}) - begin").alias("first_word")
    return pieces.select("doc_id", "source", "mark", "copy", "code", "block", first, F.expr(f"least(end, (block + 1) * {block_words}) - greatest(begin, block * {block_words})").alias("words"))


def mix_spans(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """(shard, source, slot, doc_id, mark, first_word, words): the mix itself, as the spans of words of documents that each shard holds.

    A slot's spans follow each other by doc_id, mark and first_word; mark is the xxhash64 of the text, which tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    parts, totals, found = laid_out(docs)
    sources, goals = source_table(spark, found)
    mixed = mixed_blocks(spark, [r["words"] for r in found], goals, block_words, seed)
    return mixed.join(pieces_of(parts, totals, sources, block_words), ["code", "block"]).select("shard", "source", "slot", "doc_id", "mark", "first_word", "words")


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """All rows with size, source_size, target (of their source) and taken (words of theirs in the mix's spans)."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in NAMES]
    parts, totals, found = laid_out(docs)
    sources, goals = source_table(spark, found)
    uses = mixed_blocks(spark, [r["words"] for r in found], goals, block_words, seed).groupBy("code", "block").agg(F.count("*").alias("uses"))
    pieces = pieces_of(parts, totals, sources, block_words)
    taken = pieces.join(uses, ["code", "block"]).groupBy("doc_id", "source", "mark", "copy").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark2"), F.col("copy").alias("_copy2"), "taken")

    rows = docs.select(*kept, F.xxhash64("text").alias("_mark"), size_of(F.col("text")).alias("size"))
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "source", "_mark").orderBy("size")))
    rows = rows.join(F.broadcast(sources.select(F.col("name").alias("_name"), "source_size", "target")), F.col("source").eqNullSafe(F.col("_name")), "left").drop("_name")
    both = rows.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_mark") == F.col("_mark2")) & (F.col("_copy") == F.col("_copy2")), "left")
    return both.select(*kept, "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("taken", F.lit(0)).alias("taken"))
