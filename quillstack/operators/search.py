"""Catalog queries: filters, free text and paging over gated items."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gate import passed
from .reports import tags_concat

MOST_TERMS = 6


def with_tag(items: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    """Items with a tag that isn't rejected."""
    return passed(items).join(tags.where((F.col("tag") == tag) & (F.col("state") != "rejected")).select("item_id").distinct(), "item_id", "left_semi")


def without_tag(items: DataFrame, tags: DataFrame, tag: str) -> DataFrame:
    return passed(items).join(tags.where((F.col("tag") == tag) & (F.col("state") != "rejected")).select("item_id").distinct(), "item_id", "left_anti")


def contains_text(fields: Sequence[str], text: str) -> Column:
    """Any field contains the text, whatever its case; % and _ are ordinary characters."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(F.col(f)), F.lit(text.lower())), F.lit(False)) for f in fields))


def free_text(items: DataFrame, tags: DataFrame, transcripts: DataFrame, text: str, fields: Sequence[str]) -> DataFrame:
    """Items whose fields, live tags or transcript contain the text: semi-joins united, no OR-join."""
    items = passed(items)
    own = items.where(contains_text(fields, text)).select("item_id")
    tagged = tags.where((F.col("state") != "rejected") & contains_text(["tag"], text)).select("item_id")
    spoken = transcripts.where(contains_text(["text"], text)).select("item_id")
    return items.join(own.union(tagged).union(spoken).distinct(), "item_id", "left_semi")


def catalog_query(
    items: DataFrame,
    tags: DataFrame,
    transcripts: DataFrame,
    *,
    media_type: str | None = None,
    tag_terms: Sequence[str] = (),
    favourite: str | None = None,
    without: str | None = None,
    has_transcript: bool | None = None,
    duration: tuple[float | None, float | None] = (None, None),
    resolution: str | None = None,
    text: str | None = None,
    fields: Sequence[str] = ("filename", "path"),
    page: tuple[int, int] | None = None,
    show_tags: bool = False,
) -> DataFrame:
    """Gated items that meet all given conditions; tag terms (MOST_TERMS at most) are each contained in a live tag.

    favourite is a tag to have, without one not to have; resolution is part of the resolution or the quality, of those
    columns that there are. page (seed, limit) gives that many in a repeatable order; show_tags adds a string of live tags.
    """
    if len(tag_terms) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} tag terms")
    out = passed(items)
    if media_type:
        out = out.where(F.col("media_type") == media_type)
    if duration[0] is not None:
        out = out.where(F.col("duration") >= duration[0])
    if duration[1] is not None:
        out = out.where(F.col("duration") <= duration[1])
    if resolution:
        out = out.where(contains_text([c for c in ("resolution", "quality") if c in out.columns], resolution))
    for term in tag_terms:
        hit = tags.where((F.col("state") != "rejected") & contains_text(["tag"], term)).select("item_id").distinct()
        out = out.join(hit, "item_id", "left_semi")
    if favourite:
        out = with_tag(out, tags, favourite)
    if without:
        out = without_tag(out, tags, without)
    if has_transcript is not None:
        out = out.join(transcripts.where("length(trim(text)) > 0").select("item_id").distinct(), "item_id", "left_semi" if has_transcript else "left_anti")
    out = free_text(out, tags, transcripts, text, fields) if text else out
    out = seeded_shuffle(out, *page) if page else out
    return out.join(tags_concat(tags).withColumnRenamed("tags", "_tags"), "item_id", "left").withColumn("tags", F.col("_tags")).drop("_tags") if show_tags else out


def manifest_search(sources: Mapping[str, DataFrame], text: str, limit: int | None = None) -> DataFrame:
    """Rows of many gated tables with the text in any column, tagged by source; all of them, or any `limit` of them."""
    sources = {name: passed(df).drop("review_state") for name, df in sources.items()}
    parts = [df.where(F.contains(F.lower(F.concat_ws("\n", *(F.col(c).cast("string") for c in df.columns))), F.lit(text.lower()))).withColumn("source_table", F.lit(name)) for name, df in sources.items()]
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return found if limit is None else found.limit(limit)


def recent_page(items: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page by time, newest first, with the total of all gated items."""
    live = passed(items)
    page = live.orderBy(F.desc("mtime"), F.desc("item_id")).offset(offset).limit(limit)
    return page.join(F.broadcast(live.agg(F.count("*").alias("total"))))


def seeded_shuffle(items: DataFrame, seed: int, limit: int) -> DataFrame:
    """A page in a repeatable order: (id * 1103515245 + seed) mod 2147483647; the id is reduced first, so that it can't overflow."""
    modulus, factor = 2147483647, 1103515245
    key = F.pmod(F.pmod(F.col("item_id"), F.lit(modulus)) * (factor if seed else 1) + (seed or factor), F.lit(modulus))
    return passed(items).withColumn("shuffle_key", key).orderBy("shuffle_key", "item_id").limit(limit)


def needs_timed_rerun(items: DataFrame, transcripts: DataFrame, timed: Column, silent: Column) -> DataFrame:
    """Items without a transcript or without a timed segment, confirmed silent ones left out. timed: the parsed segments."""
    state = transcripts.select("item_id", (F.coalesce(F.size(timed), F.lit(0)) > 0).alias("_timed"), F.coalesce(silent, F.lit(False)).alias("_silent"))
    state = state.groupBy("item_id").agg(F.max("_timed").alias("_timed"), F.max("_silent").alias("_silent"))
    return passed(items).join(state, "item_id", "left").where("not coalesce(_silent, false) and not coalesce(_timed, false)").drop("_timed", "_silent")


def low_confidence(items: DataFrame, labels: DataFrame, threshold: float = 0.62) -> DataFrame:
    """Items whose best label is below the threshold, or that have none."""
    best = labels.groupBy("item_id").agg(F.max("score").alias("best_score"))
    return passed(items).join(best, "item_id", "left").where(f"best_score is null or best_score < {threshold}")
