"""The review gate. Every operator that lists or scores items takes those that passed it; only a person's verdict clears an item.

Those that must see items in review, to route them or to keep their rows, take them by `routed` and hand their review_state on:
windows.mark_duplicates, windows.plan_names, joins.delete_unseen, joins.fill_probes, reports.scan_summary, and the queue and tombstones here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RULES = 1000


def review_gate(items: DataFrame, rules: DataFrame, field: str = "filename", verdicts: DataFrame | None = None) -> DataFrame:
    """Items with review_state: `review` if any rule's pattern hits the field, else `normal`.

    rules (name, pattern), MOST_RULES at most, come from the caller; all patterns are joined to one. A verdict row
    (item_id, cleared = true) of a person clears an item; nothing else does. Null fields hit no rule.
    """
    patterns = sorted(r[0] for r in rules.where("pattern is not null").select("pattern").limit(MOST_RULES + 1).collect())
    if len(patterns) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} review rules")
    hit = F.coalesce(F.col(field).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)
    marked = items.withColumn("review_state", F.when(hit, "review").otherwise("normal"))
    if verdicts is None:
        return marked
    cleared = verdicts.where("cleared").select("item_id").distinct().withColumn("_cleared", F.lit(True))
    return marked.join(cleared, "item_id", "left").withColumn("review_state", F.when(F.col("_cleared"), "normal").otherwise(F.col("review_state"))).drop("_cleared")


def passed(items: DataFrame) -> DataFrame:
    """What every other view reads: gated items that are normal and not deleted. Items must have gone through review_gate."""
    if "review_state" not in items.columns:
        raise ValueError("items must go through review_gate first")
    live = items.where("review_state = 'normal'")
    return live.where("not deleted") if "deleted" in items.columns else live


def routed(items: DataFrame) -> DataFrame:
    """For the few that must see items in review, to keep or route them: gated items, each with its review_state."""
    if "review_state" not in items.columns:
        raise ValueError("items must go through review_gate first")
    return items


def live_only(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (vectors, texts, scores) of the items that passed."""
    return rows.join(passed(items).select("item_id").distinct(), "item_id", "left_semi").select(rows.columns)


def bounded(rows: DataFrame, most: int, what: str) -> DataFrame:
    """A table that is small enough to be broadcast; it raises where it isn't."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"over {most} {what}")
    return rows


def review_queue(items: DataFrame, tags: DataFrame, risk_tag: str, limit: int) -> DataFrame:
    """Flagged items and those with a live risk tag, newest first; deleted items are not listed."""
    items = routed(items)
    flagged = items.where("review_state = 'review'")
    risky = items.join(tags.where((F.col("tag") == risk_tag) & (F.col("state") != "rejected")).select("item_id").distinct(), "item_id", "left_semi")
    both = flagged.union(risky).dropDuplicates(["item_id"])
    both = both.where("not deleted") if "deleted" in items.columns else both
    return both.orderBy(F.desc("mtime"), F.desc("item_id")).limit(limit)


def tombstone(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Marks rows as deleted; no file moves."""
    gone = ids.select("item_id").distinct().withColumn("_gone", F.lit(True))
    return routed(items).join(gone, "item_id", "left").withColumn("deleted", F.coalesce("_gone", F.lit(False))).drop("_gone")
