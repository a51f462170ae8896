"""Joins of items with moves, manifests and their own earlier names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import fill_probe, fill_resolution
from ..lineage import written
from .gate import passed, routed

GOOD_PROBES = ("ok", "partial")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")


def link_manifest(items: DataFrame, moves: DataFrame, manifest: DataFrame) -> DataFrame:
    """path -> the last applied move to it -> the last manifest row of where it came from. moves (original_path, new_path, seq); manifest (original_path, seq, ...)."""
    back = last_by(moves, "new_path", "seq").select(F.col("new_path").alias("path"), F.col("original_path").alias("moved_from"))
    rows = last_by(manifest, "original_path", "seq").drop("seq").withColumnRenamed("original_path", "_original")
    linked = passed(items).join(back, "path", "left").withColumn("origin", F.coalesce("moved_from", "path"))
    return linked.join(rows, linked["origin"] == rows["_original"], "left").drop("_original", "moved_from")


def path_keys(items: DataFrame) -> DataFrame:
    """(key, item_id): relative, absolute and slash-normalized paths."""
    absolute = F.concat_ws("/", "root", "relative_path")
    keys = items.select("item_id", F.explode(F.array("relative_path", absolute, F.replace("relative_path", F.lit("/"), F.lit("\\")))).alias("key"))
    return keys.where("key is not null").groupBy("key").agg(F.min("item_id").alias("item_id"))


def join_by_any_path(rows: DataFrame, items: DataFrame, column: str = "media_path") -> DataFrame:
    """Rows with the item_id that any form of their path finds; a key of several items goes to the smallest."""
    keys = path_keys(passed(items))
    return rows.join(keys, rows[column] == keys["key"]).drop("key")


def lookup_paths(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """Items whose relative or absolute path or name is wanted, each once."""
    items = passed(items)
    w = wanted.select(F.col("wanted").alias("_w")).distinct()
    ways = (F.col("relative_path"), F.concat_ws("/", "root", "relative_path"), F.col("filename"), F.replace("relative_path", F.lit("/"), F.lit("\\")))
    return reduce(DataFrame.union, (items.join(w, way == F.col("_w"), "left_semi") for way in ways)).dropDuplicates(["item_id"])


def delete_unseen(items: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """Drops the rows of this root that a scan didn't see; other roots stay. Items in review are kept like others, with their review_state."""
    items = routed(items)
    here = items.where(F.col("root") == root).join(seen.select("path").distinct(), "path", "left_semi").select(items.columns)
    return here.union(items.where((F.col("root") != root) | F.col("root").isNull()).select(items.columns))


def trace_original(paths: DataFrame, moves: DataFrame, max_hops: int = 16) -> DataFrame:
    """(path, origin, hops): each path followed from destination to source as far as moves go, max_hops at most.

    moves (source, dest), the first row of a destination wins; of rows with one seq the first source. Chains are built by
    doubling: a destination holds the list of its next 1, 2, 4, ... sources, and a list that is full is followed by that
    of its last member, so 16 hops take four joins. They stop when no list is full any more. A chain that comes round again
    repeats itself from there on, so its distinct members are the way to the last new one. Each step is a written table.
    """
    first = moves.where("dest is not null and source is not null").groupBy("dest").agg(F.min_by("source", F.struct("seq", "source")).alias("source"))
    chains = written(first.where("dest <> source").select(F.col("dest").alias("at"), F.array("source").alias("chain")), "chains")
    reach = 1
    while reach < max_hops:
        full = chains.where(F.size("chain") == reach)
        ahead = chains.select(F.col("at").alias("_last"), F.col("chain").alias("_more"))
        longer = full.withColumn("_last", F.element_at("chain", -1)).join(ahead, "_last")
        if reach > 1 and full.isEmpty():
            break
        grown = longer.select("at", F.concat("chain", "_more").alias("chain"))
        ended = full.withColumn("_last", F.element_at("chain", -1)).join(ahead.select("_last"), "_last", "left_anti").select("at", "chain")
        chains = written(chains.where(F.size("chain") < reach).select("at", "chain").union(ended).union(grown), "chains")
        reach *= 2
    way = F.array_distinct(F.concat(F.array("path"), F.slice(F.coalesce("chain", F.array().cast("array<string>")), 1, max_hops)))
    return paths.join(chains, paths["path"] == chains["at"], "left").select("path", way.alias("way")).select("path", F.element_at("way", -1).alias("origin"), (F.size("way") - 1).alias("hops"))


def trace_by_hash8(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """(item_id, origin) for items whose hash8 meets that of one manifest row or more; the smallest path is taken."""
    known = manifest.where("hash8 is not null").groupBy("hash8").agg(F.min("original_path").alias("origin"))
    return passed(items).where("hash8 is not null").join(known, "hash8").select("item_id", "origin")


def prefer_original_name(items: DataFrame, traced: DataFrame, normalized) -> DataFrame:  # noqa: ANN001
    """original_name: an existing one that isn't normalized stays; else the traced one, else what there is. normalized: a test on a column."""
    out = passed(items).join(traced.select("item_id", "traced_name"), "item_id", "left")
    own = F.col("original_name").isNotNull() & ~normalized(F.col("original_name"))
    return out.withColumn("original_name", F.when(own, F.col("original_name")).otherwise(F.coalesce("traced_name", "original_name"))).drop("traced_name")


def movement_log(applied: DataFrame, planned: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One log (source, dest, kind) of all moves; of several for a destination, applied comes before planned before duplicate, then the first."""
    parts = [df.select("source", "dest", "seq", F.lit(kind).alias("kind"), F.lit(i).alias("_p")) for i, (kind, df) in enumerate((("applied", applied), ("planned", planned), ("duplicate", duplicates)))]
    log = reduce(DataFrame.unionByName, parts)
    rank = F.row_number().over(Window.partitionBy("dest").orderBy("_p", "seq", "source"))
    return log.withColumn("_rn", rank).where("_rn = 1").select("source", "dest", "kind")


def fill_probes(items: DataFrame, probes: DataFrame) -> DataFrame:
    """Items with what their last good probe found; what it lacks stays as it was, and so do items without one.

    probes (item_id, probed_at, status, width, height, duration) count if their status is one of GOOD_PROBES; of those with
    one time the largest values win, null last. The resolution is that of a probe with both sides. Items in review are kept
    like others, with their review_state.
    """
    good = probes.where(F.col("status").isin(*GOOD_PROBES)).groupBy("item_id").agg(F.max(F.struct("probed_at", "width", "height", "duration")).alias("_probe"))
    old = routed(items)
    old = old if "resolution" in old.columns else old.withColumn("resolution", F.lit(None).cast("string"))
    filled = {c: fill_probe(F.col(f"_probe.{c}"), F.col(c)) for c in ("width", "height", "duration")}
    filled["resolution"] = fill_resolution(F.col("_probe.width"), F.col("_probe.height"), F.col("resolution"))
    return old.join(good, "item_id", "left").withColumns(filled).drop("_probe")


def incremental_only(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(done.select(keys).distinct(), keys, "left_anti")


def item_detail(items: DataFrame, tags: DataFrame, segments: DataFrame, audit: DataFrame, transcripts: DataFrame, newest: int = 30) -> DataFrame:
    """A nested record for each item: tags by category and name, segments by start, the newest operations, the transcript."""
    t = tags.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("category", "tag", "source", "confidence", "state"))).alias("tags"))
    s = segments.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("segments"))
    ranked = audit.withColumn("_rn", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("created_at"), F.desc("operation")))).where(f"_rn <= {newest}")
    a = ranked.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "operation", "created_at"))), lambda x: F.struct(x["operation"].alias("operation"), x["created_at"].alias("created_at"))).alias("operations"))
    x = transcripts.groupBy("item_id").agg(F.max("text").alias("transcript"))
    return passed(items).join(t, "item_id", "left").join(s, "item_id", "left").join(a, "item_id", "left").join(x, "item_id", "left")
