"""Benchmark decontamination by spaced-seed hashing, with built-in functions only.

Tokens are the runs of letters and digits of the lower-cased text. A document is contaminated by an item if some 13
neighbouring tokens of the item meet 13 neighbouring tokens of the document with at most two substitutions (items of 10
to 12 tokens: the whole item with at most one; shorter ones: the whole item as it is).

Three masks of nine places, each of which ignores three, hash every position of both sides. Any such overlap holds at
least one hit of one mask, so the hash join loses none; overlaps around the hits are then verified token by token. The
masks have three places in common. Where the benchmark's hashes are few enough to be broadcast, positions of documents
are joined by the hash of these places first, and the masks are tested on the few that meet; otherwise all masks of all
positions are shuffled. Items of under nine tokens are found by a hash of the whole item.

Defined results: null or empty text has no tokens and is clean; an empty benchmark leaves all clean; rows with a null
doc_id are checked like others; repeated rows get equal results; null items are ignored; items that share an item_id
count as one; other columns pass through, unless they have the names of results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import save

MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 2, 5, 6, 8), (0, 2, 3, 4, 7, 8))
COMMON = (0, 2, 8)  # the places of every mask
SPAN = 9
WINDOW = 13
SMALL_SEEDS = 1_000_000  # rows of hashes (24 MB) up to which the benchmark is broadcast; beyond, both sides shuffle
SMALL_ITEMS = 20_000  # items up to which their tokens are broadcast
SMALL_HITS = 200_000  # rows up to which hits are broadcast to filter the documents
NAMES = ("n_tokens", "contaminated", "n_items", "item_id")


def tokens(text: Column) -> Column:
    """Hashes of the tokens, in order."""
    return F.transform(split(text), lambda t: F.xxhash64(t))


def split(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def mask(m: int, words: str, p: str) -> str:
    """The hash of mask m at a position of an array of token hashes."""
    return f"xxhash64({m}, " + ", ".join(f"{words}[{p} + {o}]" for o in MASKS[m]) + ")"


def seeds(words: str) -> Column:
    """(pos, seed) rows: the hash of each mask at each position of an array of token hashes."""
    masks = ", ".join(mask(m, words, "p") for m in range(len(MASKS)))
    return F.expr(f"inline(flatten(transform(sequence(0, size({words}) - {SPAN}), p -> transform(array({masks}), s -> struct(p as pos, s as seed)))))")


def core(words: str) -> Column:
    """(pos, core) rows: the hash of the places that all masks have, at each position of an array of token hashes."""
    places = ", ".join(f"{words}[p + {o}]" for o in COMMON if o)
    return F.expr(f"posexplode(transform(slice({words}, 1, size({words}) - {SPAN - 1}), (w, p) -> xxhash64(w, {places})))")


def whole(words: str, length: int) -> Column:
    """(pos, seed) rows: the hash of each run of `length` tokens."""
    places = ", ".join(f"{words}[p + {o}]" for o in range(length))
    return F.expr(f"posexplode(transform(sequence(0, size({words}) - {length}), p -> xxhash64({places})))")


def places_met(words: DataFrame, items: DataFrame) -> DataFrame:
    """(id, mark, item_id, version, shift, first, last): where a mask of an item, or a short item as a whole, meets a document."""
    own = items.where(F.size("item") >= SPAN).select("item_id", "version", seeds("item")).withColumnRenamed("pos", "item_pos")
    own = save(own, "seeds")
    large = words.where(F.size("words") >= SPAN)
    if own.count() <= SMALL_SEEDS:
        masks = items.where(F.size("item") >= SPAN).select("item_id", "version", "item", core("item").alias("item_pos", "core"))
        masks = masks.select("item_id", "version", "item_pos", "core", *[F.expr(mask(m, "item", "item_pos")).alias(f"mask_{m}") for m in range(len(MASKS))])
        met = large.select("id", "mark", "words", core("words").alias("pos", "core")).join(F.broadcast(masks), "core")
        found = met.where(" or ".join(f"{mask(m, 'words', 'pos')} = mask_{m}" for m in range(len(MASKS))))
    else:
        found = large.select("id", "mark", seeds("words")).join(own, "seed")
    found = found.select("id", "mark", "item_id", "version", "pos", "item_pos")
    short = items.where(F.size("item").between(1, SPAN - 1)).select("item_id", "version", "item")
    for (length,) in sorted(short.select(F.size("item")).distinct().collect()):  # at most SPAN - 1 rows
        mine = short.where(F.size("item") == length)
        mine = mine.select("item_id", "version", F.lit(0).alias("item_pos"), F.xxhash64(*[F.col("item")[o] for o in range(length)]).alias("seed"))
        few = mine.count() <= SMALL_SEEDS
        runs = words.where(F.size("words") >= length).select("id", "mark", whole("words", length).alias("pos", "seed"))
        found = found.union(runs.join(F.broadcast(mine) if few else mine, "seed").select(*found.columns))
    return found.groupBy("id", "mark", "item_id", "version", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.min("item_pos").alias("first"), F.max("item_pos").alias("last"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: (id, mark, item_id, matched), the largest number of equal tokens in a window by document and item."""
    texts = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"), "text")
    words = texts.select("id", "mark", tokens(F.col("text")).alias("words"))
    items = benchmark.where("text is not null and item_id is not null").select("item_id", F.xxhash64("text").alias("version"), tokens(F.col("text")).alias("item")).where(F.size("item") > 0)
    items = save(items.dropDuplicates(["item_id", "version"]), "items")
    lines = save(places_met(words, items), "lines")
    few = lines.count() <= SMALL_HITS
    met = texts.join(F.broadcast(lines) if few else lines, texts["id"].eqNullSafe(lines["id"]) & (texts["mark"] == lines["mark"]))
    met = met.select(lines["id"], lines["mark"], "item_id", "version", "shift", "first", "last", tokens(F.col("text")).alias("words"))
    met = met.dropDuplicates(["id", "mark", "item_id", "version", "shift"]).join(F.broadcast(items) if items.count() <= SMALL_ITEMS else items, ["item_id", "version"])
    wide = f"least({WINDOW}, size(item))"
    met = met.withColumn("from", F.expr(f"greatest(0, -shift, first - {WINDOW})")).withColumn("to", F.expr(f"least(size(item), size(words) - shift, last + {SPAN + WINDOW})")).withColumn("wide", F.expr(wide))
    met = met.where("to - from >= wide").withColumn("equal", F.expr("transform(sequence(from, to - 1), j -> int(item[j] = words[j + shift]))"))
    met = met.withColumn("matched", F.expr("array_max(transform(sequence(1, size(equal) - wide + 1), i -> aggregate(slice(equal, i, wide), 0, (a, x) -> a + x)))"))
    allowed = "case when wide >= 13 then 2 when wide >= 10 then 1 else 0 end"
    return met.where(f"matched >= wide - ({allowed})").groupBy("id", "mark", "item_id").agg(F.max("matched").alias("matched"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All rows with n_tokens, contaminated, n_items (the items found) and item_id (the smallest of them)."""
    found = hits(docs, benchmark).groupBy("id", "mark").agg(F.count("*").alias("_items"), F.min("item_id").alias("_item"))
    found = save(found, "contaminated")
    few = found.count() <= SMALL_HITS
    kept = docs.select(*[c for c in docs.columns if c.lower() not in NAMES], F.xxhash64("text").alias("_mark"), F.size(split(F.col("text"))).cast("long").alias("n_tokens"))
    right = found.withColumnRenamed("mark", "_found_mark").withColumnRenamed("id", "_found_id")
    both = kept.join(F.broadcast(right) if few else right, kept["doc_id"].eqNullSafe(right["_found_id"]) & (kept["_mark"] == right["_found_mark"]), "left")
    return both.withColumn("contaminated", F.col("_items").isNotNull()).withColumn("n_items", F.coalesce("_items", F.lit(0))).withColumnRenamed("_item", "item_id").drop("_mark", "_found_mark", "_found_id", "_items")


ORACLE = r"""
with d as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as words from documents
), b as (
  select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as item from benchmark where text is not null
), dt as (
  select doc_id, unnest(words) as token, generate_subscripts(words, 1) as pos from d
), bt as (
  select item_id, len(item) as length, unnest(item) as token, generate_subscripts(item, 1) as item_pos from b where len(item) > 0
), m as (
  select doc_id, item_id, length, pos - item_pos as shift, item_pos, count(*) over (
    partition by doc_id, item_id, pos - item_pos order by item_pos
    range between current row and (least(13, length) - 1) following) as matched
  from dt join bt using (token)
), f as (
  select doc_id, item_id from m
  group by doc_id, item_id
  having bool_or(matched >= case when length >= 13 then 11 when length >= 10 then length - 1 else length end)
)
select d.doc_id, len(words)::bigint as n_tokens, count(f.item_id) > 0 as contaminated, count(f.item_id) as n_items, min(f.item_id) as item_id
from d left join f on f.doc_id = d.doc_id group by d.doc_id, len(words)
"""
