"""Tags from caller-supplied rules and scores, people's feedback, and centroids learned from it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..lineage import written
from .batches import found_words, matrices
from .gate import bounded, live_only, passed
from .joins import join_by_any_path

MOST_WORDS = 10_000  # words of all rules, which go to every task
CENTROIDS = 1000  # centroids that go to every task at once
IN_NAME, IN_TEXT, CONFIRMED = 0.92, 0.78, 0.85
COLUMNS = ("item_id", "tag", "category", "confidence", "source", "state")


def keyword_tags(items: DataFrame, rules: DataFrame, name: str = "filename", text: str = "text") -> DataFrame:
    """A tag for each rule (rule_order, category, tag, words) that hits: 0.92 in the name, else 0.78 in the text; from 0.85 on confirmed.

    The rule table is the caller's; it has MOST_WORDS words at most, which one automaton finds in a single pass over each
    text. One row for each item and tag; of a rule's words and categories with equal confidence the first category counts.
    """
    words, wanted = rule_words(rules, "category", "tag")
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    found = found_words(passed(items).select("item_id", low(name).alias("_name"), low(text).alias("_text")), "item_id", ("_name", "_text"), wanted)
    hits = found.join(F.broadcast(words), "word").select("item_id", "tag", "category", F.when(F.col("place") == 0, IN_NAME).otherwise(IN_TEXT).alias("confidence"))
    best = hits.groupBy("item_id", "tag").agg(F.min("category").alias("category"), F.max("confidence").alias("confidence"))
    return best.select("item_id", "tag", "category", "confidence", F.lit("keyword").alias("source"), F.when(F.col("confidence") >= CONFIRMED, "confirmed").otherwise("pending").alias("state"))


def rule_words(rules: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """(the columns with each lower-case word of a rule, MOST_WORDS at most; the words)."""
    words = rules.select(*columns, F.explode("words").alias("word")).where("word is not null").select(*columns, F.lower("word").alias("word"))
    words = bounded(words, MOST_WORDS, "rule words")
    return words, [r["word"] for r in words.select("word").distinct().collect()]


def first_category(items: DataFrame, rules: DataFrame, text: Column) -> DataFrame:
    """(item_id, category) of the first rule that hits, in rule order."""
    words, wanted = rule_words(rules, "rule_order", "category")
    hits = found_words(passed(items).select("item_id", F.lower(text).alias("_text")), "item_id", ("_text",), wanted).join(F.broadcast(words), "word")
    return hits.groupBy("item_id").agg(F.min_by("category", "rule_order").alias("category"))


def import_labels(labels: DataFrame, confirmed: float = 0.70) -> DataFrame:
    """Tags of label rows (item_id, label, score text); a score that is no number is 0."""
    score = F.coalesce(F.col("score").try_cast("double"), F.lit(0.0))
    best = labels.select("item_id", F.col("label").alias("tag"), score.alias("confidence")).groupBy("item_id", "tag").agg(F.max("confidence").alias("confidence"))
    return best.select("item_id", "tag", F.lit("label").alias("category"), "confidence", F.lit("import").alias("source"), F.when(F.col("confidence") >= confirmed, "confirmed").otherwise("pending").alias("state"))


def import_labels_by_path(labels: DataFrame, items: DataFrame, column: str = "media_path", confirmed: float = 0.70) -> DataFrame:
    """Tags of label rows (media_path, label, score text) for the items that any form of their path finds; other rows go."""
    return import_labels(join_by_any_path(labels.select(column, "label", "score"), items, column), confirmed)


def pool_label_scores(scores: DataFrame) -> DataFrame:
    """(item_id, label, score, frame): per label mean * (0.75 + 0.25 * min(1, n / min(3, frames))); the best label wins, with its best frame."""
    frames = scores.groupBy("item_id").agg(F.count_distinct("frame").alias("frames"))
    own = scores.groupBy("item_id", "label").agg(F.avg("score").alias("mean"), F.count("*").alias("n"), F.max_by("frame", F.struct("score", -F.col("frame"))).alias("frame"))
    share = F.least(F.lit(1.0), F.col("n") / F.least(F.lit(3), F.col("frames")))
    pooled = own.join(frames, "item_id").select("item_id", "label", (F.col("mean") * (0.75 + 0.25 * share)).alias("score"), "frame")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "label")
    return pooled.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def upsert_tags(old: DataFrame, new: DataFrame, owned_sources: list[str]) -> DataFrame:
    """Rows of owned sources are replaced, for the items that the new rows speak of; all others stay."""
    touched = new.select("item_id").distinct().withColumn("_touched", F.lit(True))
    kept = old.join(touched, "item_id", "left").where(~(F.coalesce("_touched", F.lit(False)) & F.col("source").isin(*owned_sources)))
    return kept.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def last_feedback(feedback: DataFrame) -> DataFrame:
    """(item_id, tag, category, verdict, note, updated_at): the last verdict of each item, tag and category, 1 or -1, with its note."""
    note = F.col("note") if "note" in feedback.columns else F.lit(None).cast("string")
    tag = F.trim("tag")
    rows = feedback.where(F.length(tag) > 0).select("item_id", tag.alias("tag"), F.coalesce("category", F.lit("")).alias("category"), F.struct("updated_at", F.when(F.col("verdict") > 0, 1).otherwise(-1).alias("verdict"), F.trim(note).alias("note")).alias("v"))
    return rows.groupBy("item_id", "tag", "category").agg(F.max("v").alias("v")).select("item_id", "tag", "category", "v.verdict", "v.note", "v.updated_at")


def feedback_audit(feedback: DataFrame) -> DataFrame:
    """An audit row (item_id, operation, detail, created_at) for each verdict that was given."""
    given = feedback.where(F.length(F.trim("tag")) > 0)
    return given.select("item_id", F.lit("tag_feedback").alias("operation"), F.concat(F.trim("tag"), F.lit("="), F.when(F.col("verdict") > 0, "1").otherwise("-1")).alias("detail"), F.col("updated_at").alias("created_at"))


def feedback_overlay(tags: DataFrame, feedback: DataFrame) -> DataFrame:
    """People's last verdicts by item, tag and category over the tags.

    A -1 rejects every source of the tag, whatever its category. The newest +1 makes a manual tag of 1.0 with its own category,
    in place of an older manual one; it is confirmed unless a -1 of another category came later.
    """
    last = last_feedback(feedback)
    up, down = F.col("verdict") == 1, F.col("verdict") == -1
    judged = last.groupBy("item_id", "tag").agg(F.max(F.when(down, F.col("updated_at"))).alias("_down"), F.count_if(down).alias("_downs"), F.max(F.when(up, F.struct("updated_at", "category"))).alias("_up"))
    both = tags.join(judged, ["item_id", "tag"], "left")
    others = both.where("not (_up is not null and source = 'manual')").withColumn("state", F.when(F.col("_downs") > 0, "rejected").otherwise(F.col("state"))).select(*COLUMNS)
    state = F.when(F.col("_down") > F.col("_up.updated_at"), "rejected").otherwise("confirmed")
    manual = judged.where("_up is not null").select("item_id", "tag", F.col("_up.category").alias("category"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"), state.alias("state"))
    return others.unionByName(manual)


def manual_tag(tags: DataFrame, wanted: DataFrame, tag: str, category: str = "manual") -> DataFrame:
    """Sets a manual tag on the items of wanted (item_id, on), or takes it off."""
    ids = wanted.select("item_id").distinct()
    kept = tags.where((F.col("tag") != tag) | (F.col("source") != "manual")).unionByName(tags.where((F.col("tag") == tag) & (F.col("source") == "manual")).join(ids, "item_id", "left_anti").select(tags.columns))
    new = wanted.where("on").select("item_id").distinct().select("item_id", F.lit(tag).alias("tag"), F.lit(category).alias("category"), F.lit(1.0).alias("confidence"), F.lit("manual").alias("source"), F.lit("confirmed").alias("state"))
    return kept.select(*COLUMNS).unionByName(new)


def favorite_overlay(tags: DataFrame, wanted: DataFrame, marker: str = "favourite") -> DataFrame:
    return manual_tag(tags, wanted, marker, "marker")


def unit(vector: Column) -> Column:
    """The vector by its length, which is computed once; zeros if it has none."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(vector, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))), F.lit(0))


def _mean_vectors(rows: DataFrame, by: list[str]) -> DataFrame:
    """The unit vector of the mean, for each key."""
    means = rows.select(*by, F.posexplode("vector").alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("x"))
    lists = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    return lists.select(*by, unit(F.col("mean")).alias("centroid"))


def train_centroids(items: DataFrame, vectors: DataFrame, feedback: DataFrame, min_pos: int = 2) -> DataFrame:
    """(tag, positive, negative, threshold, n_pos, n_neg) for tags with min_pos positives; threshold 0.62, or 0.68 without negatives.

    Only vectors of gated items count.
    """
    vectors = live_only(vectors, items)
    rows = vectors.select("item_id", "vector").join(feedback.select("item_id", "tag", "verdict"), "item_id")
    sides = _mean_vectors(rows, ["tag", "verdict"])
    counts = centroid_status(feedback.join(vectors.select("item_id").distinct(), "item_id", "left_semi"))
    p, n = sides.where("verdict = 1").select("tag", F.col("centroid").alias("positive")), sides.where("verdict = -1").select("tag", F.col("centroid").alias("negative"))
    return counts.where(F.col("n_pos") >= min_pos).join(p, "tag").join(n, "tag", "left").select("tag", "positive", "negative", F.when(F.col("negative").isNull(), 0.68).otherwise(0.62).alias("threshold"), "n_pos", "n_neg")


def centroid_status(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("tag").agg(F.count_if(F.col("verdict") == 1).alias("n_pos"), F.count_if(F.col("verdict") == -1).alias("n_neg"))


def dot(a: Column, b: Column) -> Column:
    """The product of two arrays, cut to the shorter one; 0 with null."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def apply_centroids(items: DataFrame, vectors: DataFrame, centroids: DataFrame, confirmed: float = 0.76) -> DataFrame:
    """Tags of gated items by sigmoid(8 * (v.positive - v.negative)) from the threshold on.

    A batch of vectors is multiplied with the matrix of CENTROIDS centroids at a time, and only what reaches its threshold
    leaves the task. Vectors and centroids of unequal length are cut to the shorter one; a missing negative counts as zeros.
    """
    live = live_only(vectors.select("item_id", "vector"), items)
    table = written(centroids.select("tag", "positive", "negative", "threshold"), "centroids")
    blocks = table.count() // CENTROIDS + 1
    block = F.pmod(F.xxhash64("tag"), F.lit(blocks))
    parts = [centroid_scores(live, table.where(block == b).toArrow()) for b in range(blocks)]
    out = reduce(DataFrame.union, parts)
    return out.select("item_id", "tag", F.lit("learned").alias("category"), "confidence", F.lit("centroid").alias("source"), F.when(F.col("confidence") >= confirmed, "confirmed").otherwise("pending").alias("state"))


def padded(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of one matrix, filled up with zeros; a null vector is all zeros."""
    out = np.zeros((len(column), width))
    for rows, matrix in matrices(column):
        out[rows, : matrix.shape[1]] = matrix
    return out


def centroid_scores(vectors: DataFrame, table: pa.Table) -> DataFrame:
    """(item_id, tag, confidence) of all vectors with about CENTROIDS centroids, where it reaches the centroid's threshold."""
    tags = table.column("tag").to_pylist()
    least = np.array(table.column("threshold").to_pylist(), float)
    sides = [table.column(c) for c in ("positive", "negative")]
    width = max((len(v) for side in sides for v in side.to_pylist() if v is not None), default=0)
    difference = padded(sides[0], width) - padded(sides[1], width)
    shared = vectors.sparkSession.sparkContext.broadcast((tags, least, difference))
    item = vectors.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, least, difference = shared.value
        names = pa.array(tags, pa.string())
        for batch in batches:
            for rows, matrix in matrices(batch.column(1)):
                for lo in range(0, len(rows), 1024):
                    part = matrix[lo : lo + 1024]
                    both = min(part.shape[1], difference.shape[1])
                    score = 1 / (1 + np.exp(-np.clip(8 * (part[:, :both] @ difference[:, :both].T), -60, 60)))
                    at, tag = np.nonzero(score >= least)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[lo : lo + 1024][at])), names.take(pa.array(tag)), pa.array(score[at, tag])], ["item_id", "tag", "confidence"])

    return vectors.mapInArrow(run, f"item_id {item}, tag string, confidence double")
