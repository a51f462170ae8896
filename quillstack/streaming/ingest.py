"""Watching folders and event streams with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from ..operators.gate import passed, review_gate
from ..operators.tagging import keyword_tags
from ..sources import commits

SIGNATURE = ["files", "bytes", "latest", "digest"]


def watch_signature(files: DataFrame, *by: str) -> DataFrame:
    """A row that changes when files do, for each value of the columns `by` (a root, say): count, bytes, latest time, digest.

    The digest is the sum of 60 bits of the MD5 of each file's path, size and time in seconds: it needs no order, and any SQL
    engine can repeat it. Null sizes and times count as empty.
    """
    text = F.concat_ws("|", F.coalesce("path", F.lit("")), F.coalesce(F.col("size_bytes").cast("string"), F.lit("")), F.coalesce(F.unix_seconds("mtime").cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    sums = F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.max("mtime").alias("latest"), F.coalesce(F.sum(bits), F.lit(0)).cast("string").alias("digest")
    return files.groupBy(*by).agg(*sums) if by else files.agg(*sums)


def watch_changes(now: DataFrame, last: DataFrame, by: str = "root") -> DataFrame:
    """(root, change, files, bytes, latest, digest) of the roots whose signature isn't the last one: new, changed or gone. Those that are gone have the last one."""
    old = last.select(F.col(by).alias("_by"), F.struct(*SIGNATURE).alias("_old"))
    both = now.select(by, F.struct(*SIGNATURE).alias("_new")).join(old, F.col(by).eqNullSafe(F.col("_by")), "full_outer")
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.col("_old.digest") != F.col("_new.digest"), "changed").when(F.col("_old.files") != F.col("_new.files"), "changed")
    return both.select(F.coalesce(by, "_by").alias(by), change.alias("change"), F.coalesce("_new", "_old").alias("_s")).where("change is not null").select(by, "change", "_s.*")


def watch(files: DataFrame, folder: str, by: str = "root") -> DataFrame:
    """Compares each root's signature with the one kept in a folder, keeps the new ones there, and returns the roots that changed.

    The first call has nothing to compare with: every root is new. A call that fails before its mark leaves the last state as it is.
    """
    spark = files.sparkSession
    seen = commits.numbers(spark, folder)
    number = seen[-1][0] + 1 if seen else 0
    watch_signature(files, by).write.mode("overwrite").parquet(commits.part(folder, number, "signatures", "snapshot"))
    now = spark.read.parquet(commits.part(folder, number, "signatures", "snapshot"))
    last = commits.read(spark, folder, "signatures")
    changes = watch_changes(now, now.limit(0) if last is None else last, by)
    changes.write.mode("overwrite").parquet(commits.part(folder, number, "changes", "snapshot"))
    commits.mark(spark, folder, number, "snapshot")
    return spark.read.schema(changes.schema).parquet(commits.part(folder, number, "changes", "snapshot"))


def newest(rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One row for each key: of the last batch, then by the columns of `order`, then by the row's hash."""
    last = Window.partitionBy(key).orderBy(F.desc("_batch"), *(F.desc(c) for c in order), F.xxhash64(*rows.columns))
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def upsert_batch(items: DataFrame, tags: DataFrame, number: int, folder: str, order: Sequence[str] = ()) -> bool:
    """Adds a batch of gated items and their tags to a folder, once: a batch that is there already changes nothing (False)."""
    spark = items.sparkSession
    if commits.marked(spark, folder, number):
        return False
    rows = newest(items.withColumn("_batch", F.lit(number)), "item_id", order).drop("_batch")
    rows.write.mode("overwrite").parquet(commits.part(folder, number, "items"))
    tags.write.mode("overwrite").parquet(commits.part(folder, number, "tags"))
    commits.mark(spark, folder, number)
    return True


def current_items(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last row of each item, with its review_state; None before the first batch."""
    rows = commits.read(spark, folder, "items")
    return None if rows is None else newest(rows, "item_id").drop("_batch")


def current_tags(spark: SparkSession, folder: str) -> DataFrame | None:
    """The tags of each item's last batch: a later batch of an item replaces all that this stream made for it."""
    items, tags = commits.read(spark, folder, "items"), commits.read(spark, folder, "tags")
    if items is None:
        return None
    last = items.groupBy("item_id").agg(F.max("_batch").alias("_batch"))
    return tags.join(last, ["item_id", "_batch"], "left_semi").drop("_batch")


def compact(spark: SparkSession, folder: str) -> None:
    """Writes the current state as one snapshot, which readers take in place of all batches so far."""
    found = commits.numbers(spark, folder)
    if len(found) < 2:
        return
    number = found[-1][0]
    current_items(spark, folder).write.mode("overwrite").parquet(commits.part(folder, number, "items", "snapshot"))
    current_tags(spark, folder).write.mode("overwrite").parquet(commits.part(folder, number, "tags", "snapshot"))
    commits.mark(spark, folder, number, "snapshot")


def ingest_stream(spark: SparkSession, folder: str, schema: T.StructType, rules: DataFrame, review_rules: DataFrame, sink: str | Callable[[DataFrame, DataFrame, int], None], checkpoint: str, files_per_trigger: int = 100) -> StreamingQuery:
    """New files -> gate -> keyword tags -> upsert; restarts go on from the checkpoint.

    sink is the folder that upsert_batch adds each batch to, once, however often it is played; current_items and current_tags
    read it. Or it is a function of the caller's, sink(items, tags, batch id).
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        gated = review_gate(df, review_rules)
        tags = keyword_tags(passed(gated), rules)
        if isinstance(sink, str):
            upsert_batch(gated, tags, number, sink)
        else:
            sink(gated, tags, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Drops rows whose (type, size, hash) came before, within the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["media_type", "size_bytes", "sha256"])


def ingest_rate(events: DataFrame, width: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """(start, processed, failed) by tumbling window; later rows than the delay are dropped on a stream."""
    marked = events.withWatermark("ts", delay) if events.isStreaming else events
    sums = marked.groupBy(F.window("ts", width).alias("w")).agg(F.count_if(F.col("outcome") == "processed").alias("processed"), F.count_if(F.col("outcome") == "failed").alias("failed"))
    return sums.select(F.col("w.start").alias("start"), "processed", "failed")
