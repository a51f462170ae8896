"""Aggregations: storage, coverage, quality gates, words, tags and their co-occurrence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import found_words
from .gate import bounded, passed, routed
from .tagging import rule_words

MOST_MINIMA = 10_000
WORD = r"([A-Za-z]{3,}|[\x{4e00}-\x{9fff}]{2,})"


def storage_by_type(items: DataFrame) -> DataFrame:
    """Count and bytes of gated items by type; unknown types are other."""
    kind = F.when(F.col("media_type").isin("video", "photo"), F.col("media_type")).otherwise("other")
    return passed(items).groupBy(kind.alias("media_type")).agg(F.count("*").alias("items"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def percent(ready: Column, total: Column) -> Column:
    """0 to 100, half-even; 0 without a total."""
    return F.when(total > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.try_divide(ready * 100.0, total), 0)))).otherwise(0).cast("int")


def coverage_report(items: DataFrame, capabilities: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(id, ready, total, percent) of each capability (applies, is ready), in one pass over the items."""
    sums = []
    for name, (applies, ready) in capabilities.items():
        sums += [F.coalesce(F.sum(F.when(applies & ready, 1)), F.lit(0)).cast("long").alias(f"{name}_ready"), F.coalesce(F.sum(F.when(applies, 1)), F.lit(0)).cast("long").alias(f"{name}_total")]
    flat = passed(items).agg(*sums)
    rows = ", ".join(f"'{n}', `{n}_ready`, `{n}_total`" for n in capabilities)
    out = flat.select(F.expr(f"stack({len(capabilities)}, {rows}) as (id, ready, total)"))
    return out.withColumn("percent", percent(F.col("ready"), F.col("total")))


def recommendations(coverage: DataFrame) -> DataFrame:
    """Capabilities under 90 percent: warning from 50 on, else error."""
    return coverage.where("percent < 90").withColumn("level", F.when(F.col("percent") >= 50, "warning").otherwise("error"))


def quality_gate(coverage: DataFrame, minima: DataFrame) -> DataFrame:
    """(id, total, percent, minimum, passed) of each minimum; a total of 0 passes, a missing capability counts as total 0."""
    out = F.broadcast(bounded(minima, MOST_MINIMA, "minima")).join(coverage, "id", "left")  # minima: a row for each capability
    return out.select("id", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("percent", F.lit(0)).alias("percent"), "minimum", ((F.coalesce("total", F.lit(0)) == 0) | (F.col("percent") >= F.col("minimum"))).alias("passed"))


def gate_ok(gate: DataFrame) -> DataFrame:
    return gate.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("ok"), F.count_if(~F.col("passed")).alias("warnings"))


def word_counts(texts: DataFrame, column: str = "text", least: int = 2, stop: DataFrame | None = None) -> DataFrame:
    """Words (Latin from three letters, CJK from two) of gated items with their counts from `least` on."""
    words = passed(texts).select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(WORD), F.lit(1))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(stop.select("word"), "word", "left_anti") if stop is not None else counts


def hashtag_counts(texts: DataFrame, rules: DataFrame, column: str = "text") -> DataFrame:
    """`#token` counts with the category of the first rule (rule_order, category, words) that a tag contains a word of, or noise."""
    tags = passed(texts).select(F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    words, wanted = rule_words(rules, "rule_order", "category")
    hits = found_words(tags.select("tag", F.col("tag").alias("_text")), "tag", ("_text",), wanted).join(F.broadcast(words), "word").groupBy("tag").agg(F.min_by("category", "rule_order").alias("category"))
    return tags.join(hits, "tag", "left").select("tag", "n", F.coalesce("category", F.lit("noise")).alias("category"))


def scan_summary(plan: DataFrame) -> DataFrame:
    """One row of counts, items in review among them: by type and action, flagged ones and duplicates."""
    return routed(plan).agg(
        F.count("*").alias("items"),
        F.count_if(F.col("media_type") == "video").alias("videos"),
        F.count_if(F.col("media_type") == "photo").alias("photos"),
        F.count_if(F.col("action") == "keep").alias("kept"),
        F.count_if(F.col("action") == "move").alias("moved"),
        F.count_if(F.col("action") == "review").alias("reviewed"),
        F.count_if(F.size("flags") > 0).alias("flagged"),
        F.count_if(F.col("duplicate")).alias("duplicates"),
    )


def moves_rollup(moves: DataFrame) -> DataFrame:
    """(status, top_folder, rows): by status, and by top folder for moved and duplicate rows."""
    top = F.when(F.col("status").isin("moved", "duplicate"), F.get(F.split("dest", "/"), F.lit(0))).otherwise("")
    return moves.groupBy("status", top.alias("top_folder")).agg(F.count("*").alias("rows"))


def tag_stats(tags: DataFrame, limit: int) -> DataFrame:
    live = tags.where("state <> 'rejected'")
    return live.groupBy("tag", "category").agg(F.count_distinct("item_id").alias("items"), F.avg("confidence").alias("confidence")).orderBy(F.desc("items"), "tag", "category").limit(limit)


def tag_cooccurrence(tags: DataFrame, top_nodes: int, min_edge: int, top_edges: int) -> DataFrame:
    """(tag_a, tag_b, weight): unordered pairs of the top tags by common items. The self-join sees top_nodes tags of an item at most."""
    own = tags.where("state <> 'rejected'").select("item_id", "tag").distinct()
    nodes = own.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(top_nodes).select("tag")
    own = own.join(F.broadcast(nodes), "tag")  # top_nodes rows
    sets = own.groupBy("item_id").agg(F.sort_array(F.collect_list("tag")).alias("tags")).where(F.size("tags") > 1)
    pairs = sets.select(F.expr("inline(flatten(transform(tags, (a, i) -> transform(slice(tags, i + 2, size(tags)), b -> struct(a as tag_a, b as tag_b)))))"))
    return pairs.groupBy("tag_a", "tag_b").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_edge).orderBy(F.desc("weight"), "tag_a", "tag_b").limit(top_edges)


def tags_concat(tags: DataFrame) -> DataFrame:
    """One string of the live tags of each item, in order."""
    return tags.where("state <> 'rejected'").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
