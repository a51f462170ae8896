"""Duplicates, similarity groups, timelines and name plans by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import written
from .gate import passed, routed
from .vectors import dhash_bits

SMALL_PICTURES = 100_000  # hashes of pictures that go to every task; more are joined by a shuffle


def mark_duplicates(items: DataFrame, keys: tuple[str, ...] = ("media_type", "size_bytes", "sha256")) -> DataFrame:
    """duplicate_role: keep or candidate within groups of two or more by the keys, else single. Null, empty and `ERR_` hashes group nothing.

    The first path is found by an aggregate that combines before the shuffle, and joined back, so that a large group of
    copies can be split between tasks. Items in review are marked like others, with their review_state: plan_names routes
    them, and every view drops them.
    """
    items = routed(items)
    last = keys[-1]
    good = F.col(last).isNotNull() & (F.col(last) != "") & ~F.coalesce(F.startswith(F.col(last), F.lit("ERR_")), F.lit(False))
    groups = items.where(good).groupBy(*keys).agg(F.count("*").alias("group_size"), F.min(F.struct("path", "item_id")).alias("_first")).where("group_size > 1")
    out = items.join(groups, list(keys), "left")
    role = F.when(F.col("_first").isNull(), "single").when(F.struct("path", "item_id") == F.col("_first"), "keep").otherwise("candidate")
    return out.withColumn("duplicate_role", role).withColumn("group_key", F.when(F.col("_first").isNotNull(), F.concat_ws(":", *keys))).drop("_first")


def two_stage_dedupe(files: DataFrame) -> DataFrame:
    """A cheap key (name without its hash, size) first; a digest of the content only in groups of two or more.

    Gated files (path, filename, size_bytes, content) -> (path, cheap_key, digest, rank): rank 1 stays.
    """
    files = passed(files)
    masked = F.regexp_replace("filename", r"[_-][0-9A-Fa-f]{8}(\.[A-Za-z0-9]+)$", "$1")
    keyed = files.withColumn("cheap_key", F.concat_ws(":", masked, F.col("size_bytes").cast("string")))
    rivals = keyed.groupBy("cheap_key").agg(F.count("*").alias("_n")).where("_n > 1").select("cheap_key")
    digests = keyed.join(rivals, "cheap_key", "left_semi").select("path", "cheap_key", F.md5("content").alias("digest"))
    rank = F.row_number().over(Window.partitionBy("cheap_key", "digest").orderBy("path"))
    return digests.withColumn("rank", rank)


def similarity_index(items: DataFrame, kind: str, signature: Column) -> DataFrame:
    """(kind, signature, item_id, role): groups of two or more by a signature; the largest file, then the first path, stays. Empty signatures group nothing."""
    signed = passed(items).withColumn("signature", signature).where("signature is not null and signature <> ''")
    order = F.struct(-F.coalesce("size_bytes", F.lit(0)), F.coalesce("path", F.lit("")), "item_id")
    counts = signed.groupBy("signature").agg(F.count("*").alias("members"), F.min_by("item_id", order).alias("_keep")).where("members > 1")
    return signed.join(counts, "signature").select(F.lit(kind).alias("kind"), "signature", "item_id", "path", "size_bytes", "members", F.when(F.col("item_id") == F.col("_keep"), "keep").otherwise("candidate").alias("role"))


def similarity_listing(index: DataFrame, limit: int) -> DataFrame:
    """Members of the largest groups, the kept one first."""
    top = index.groupBy("kind", "signature").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "kind", "signature").limit(limit).select("kind", "signature")
    member = F.row_number().over(Window.partitionBy("kind", "signature").orderBy(F.when(F.col("role") == "keep", 0).otherwise(1), F.desc(F.coalesce("size_bytes", F.lit(0))), F.coalesce("path", F.lit("")), "item_id"))
    return index.join(F.broadcast(top), ["kind", "signature"]).withColumn("position", member)


def timeline_segments(samples: DataFrame, step: int = 7) -> DataFrame:
    """samples (item_id, refs, times) -> (item_id, idx, start, end, ref): each ends where the next begins, at least 1 s on; the last after `step`. A missing time is step * idx."""
    rows = samples.select("item_id", F.posexplode(F.arrays_zip("refs", "times")).alias("idx", "s")).select("item_id", "idx", F.coalesce("s.times", F.col("idx") * F.lit(float(step))).alias("start"), F.col("s.refs").alias("ref"))
    following = F.lead("start").over(Window.partitionBy("item_id").orderBy("idx"))
    return rows.select("item_id", "idx", "start", F.when(following.isNull(), F.col("start") + step).otherwise(F.greatest(F.col("start") + 1, following)).alias("end"), "ref")


def first_k_signature(segments: DataFrame, k: int = 3) -> DataFrame:
    """The first k refs that aren't empty, by start, joined."""
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("start", "idx"))
    top = segments.where("ref is not null and ref <> ''").withColumn("_rn", rank).where(f"_rn <= {k}")
    return top.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "ref"))), lambda s: s["ref"]), "|").alias("signature"))


def frame_fingerprint(frames: DataFrame, k: int = 3, pictures: DataFrame | None = None) -> DataFrame:
    """(item_id, signature): the dhash of each of the first k frames that have a picture, in order of start, joined by `|`.

    frames (item_id, idx, start, luma): a 9 x 8 grid of each frame. Where frames share their grids, give frames (item_id, idx, start,
    picture) and pictures (picture, luma): each is hashed once, and no grid travels with a frame. A frame whose grid isn't 72
    values has no hash, but keeps its place among the first k; an item without any hash has no signature. Frames of one start go by idx.
    """
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy("start", "idx"))
    if pictures is None:
        top = frames.where("luma is not null").withColumn("_rn", rank).where(f"_rn <= {k}").select("item_id", "_rn", dhash_bits(F.col("luma")).alias("ref"))
    else:
        prints = written(pictures.where("luma is not null").select("picture", dhash_bits(F.col("luma")).alias("ref")), "prints")
        prints = F.broadcast(prints) if prints.count() <= SMALL_PICTURES else prints
        top = frames.select("item_id", "idx", "start", "picture").join(prints, "picture").withColumn("_rn", rank).where(f"_rn <= {k}").select("item_id", "_rn", "ref")
    hashed = top.where("ref is not null")
    return hashed.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "ref"))), lambda s: s["ref"]), "|").alias("signature"))


def plan_names(items: DataFrame) -> DataFrame:
    """(item_id, route, target): review before duplicates, probe errors, category and month; collisions get _002 and on.

    items: item_id, path, ext, review_state, duplicate_role, probe_error, category, date_key, slug.
    """
    items = routed(items)
    month = F.concat_ws("-", F.substring("date_key", 1, 4), F.substring("date_key", 5, 2))
    route = (
        F.when(F.col("review_state") == "review", "review")
        .when(F.col("duplicate_role") == "candidate", "duplicates")
        .when(F.length("probe_error") > 0, "probe_errors")
        .when(F.col("category").isNotNull(), F.concat(F.lit("by_category/"), F.col("category")))
        .otherwise(F.concat(F.lit("by_month/"), month))
    )
    stem = F.concat_ws("_", F.col("date_key"), F.col("slug"))
    planned = items.select("item_id", "path", "ext", route.alias("route"), F.concat_ws("/", route, stem).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_base", "ext").orderBy("path", "item_id"))
    target = F.concat("_base", F.when(rank > 1, F.format_string("_%03d", rank)).otherwise(""), F.lit("."), F.col("ext"))
    return planned.select("item_id", "route", target.alias("target"))
