"""Every public function of the operators: refused without a gate, and no item in review with one."""

import inspect
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillstack.functions import names
from quillstack.operators import gate, joins, reports, search, tagging, vectors, windows
from quillstack.sources import readers

AT = datetime(2024, 1, 1)
REVIEW = {3, 5}


def items(spark):
    rows = [(i, "r", f"{n}.mp4", f"r/{n}.mp4", f"{n}.mp4", "video", 10, f"h{i}", f"{i:08x}", AT, t, None) for i, n, t in ((1, "aa", "alpha #one"), (2, "bb", "beta #two"), (3, "cc", "hold gamma #three"), (4, "dd", "delta #four"), (5, "ee", "hold omega #five"))]
    return spark.createDataFrame(rows, "item_id long, root string, relative_path string, path string, filename string, media_type string, size_bytes long, sha256 string, hash8 string, mtime timestamp, text string, duration double").withColumns({"width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "original_name": F.col("filename"), "content": F.col("text").cast("binary"), "kind": F.lit("text")})


def gated(spark):
    return gate.review_gate(items(spark), spark.createDataFrame([("r", "hold")], "name string, pattern string"), "text")


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def vecs(spark):
    return table(spark, "item_id long, kind string, model string, vector array<double>", *((i, "image", "m", [1.0, 0.5]) for i in range(1, 6)))


def rules(spark):
    return table(spark, "rule_order int, category string, tag string, words array<string>", (1, "c", "t", ["a", "e", "o"]))


def all_tags(spark):
    return table(spark, "item_id long, tag string, category string, confidence double, source string, state string", *((i, "t", "c", 0.9, "x", "confirmed") for i in range(1, 6)))


def none(spark, schema="item_id long, text string"):
    return table(spark, schema)


def centroids(spark):
    return table(spark, "tag string, positive array<double>, negative array<double>, threshold double", ("t", [1.0, 0.0], None, 0.1))


VIEWS = {
    search.with_tag: lambda s, x: search.with_tag(x, all_tags(s), "t"),
    search.without_tag: lambda s, x: search.without_tag(x, all_tags(s), "none"),
    search.free_text: lambda s, x: search.free_text(x, all_tags(s), none(s), "t", ["filename"]),
    search.catalog_query: lambda s, x: search.catalog_query(x, all_tags(s), none(s)),
    search.manifest_search: lambda s, x: search.manifest_search({"items": x}, "mp4"),
    search.recent_page: lambda s, x: search.recent_page(x, 10),
    search.seeded_shuffle: lambda s, x: search.seeded_shuffle(x, 1, 10),
    search.needs_timed_rerun: lambda s, x: search.needs_timed_rerun(x, none(s), F.array(), F.lit(False)),
    search.low_confidence: lambda s, x: search.low_confidence(x, none(s, "item_id long, score double")),
    joins.link_manifest: lambda s, x: joins.link_manifest(x, none(s, "original_path string, new_path string, seq int"), none(s, "original_path string, seq int, size int")),
    joins.path_keys: lambda s, x: joins.join_by_any_path(items(s).select(F.col("path").alias("media_path")), x),
    joins.join_by_any_path: lambda s, x: joins.join_by_any_path(items(s).select(F.col("path").alias("media_path")), x),
    joins.lookup_paths: lambda s, x: joins.lookup_paths(x, items(s).select(F.col("filename").alias("wanted"))),
    joins.trace_by_hash8: lambda s, x: joins.trace_by_hash8(x, items(s).select("hash8", F.col("path").alias("original_path"))),
    joins.prefer_original_name: lambda s, x: joins.prefer_original_name(x, none(s, "item_id long, traced_name string"), names.is_normalized_name),
    joins.item_detail: lambda s, x: joins.item_detail(x, all_tags(s), none(s, "item_id long, start double, end double, label string"), none(s, "item_id long, operation string, created_at timestamp"), none(s)),
    tagging.keyword_tags: lambda s, x: tagging.keyword_tags(x, rules(s)),
    tagging.first_category: lambda s, x: tagging.first_category(x, rules(s), F.col("text")),
    tagging.import_labels_by_path: lambda s, x: tagging.import_labels_by_path(items(s).select(F.col("path").alias("media_path"), F.lit("l").alias("label"), F.lit("1").alias("score")), x),
    tagging.apply_centroids: lambda s, x: tagging.apply_centroids(x, vecs(s), centroids(s)),
    windows.two_stage_dedupe: lambda s, x: windows.two_stage_dedupe(x.withColumn("filename", F.lit("same"))).join(items(s).select("path", "item_id"), "path"),
    windows.similarity_index: lambda s, x: windows.similarity_index(x, "k", F.lit("same")),
    vectors.import_vectors: lambda s, x: vectors.import_vectors(x, items(s).select(F.col("path").alias("media_path"), F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("embedding")), none(s, "item_id long, model string"))[0],
    vectors.placed_vectors: lambda s, x: vectors.placed_vectors(x, items(s).select(F.col("path").alias("media_path"), F.lit("m").alias("model"), F.array(F.lit(1.0)).alias("embedding")), none(s, "item_id long, model string")).where("outcome = 'imported'"),
    vectors.vector_index: lambda s, x: vectors.vector_index(x, items(s).select("item_id", "kind", "text"), none(s, "item_id long, kind string, model string, text_hash string"), "m"),
    vectors.cosine_topk: lambda s, x: vectors.cosine_topk(x, vecs(s), vecs(s).where("item_id = 1").withColumnRenamed("item_id", "query_id"), 9),
    vectors.semantic_search: lambda s, x: vectors.semantic_search(x, vecs(s), vecs(s).where("item_id = 1").withColumnRenamed("item_id", "query_id"), items(s).select("item_id", "text"), 9),
    vectors.search_or_text: lambda s, x: vectors.search_or_text(none(s), x, all_tags(s), none(s), "t", 9),
    readers.missing_hash: lambda s, x: readers.missing_hash(x.withColumn("sha256", F.lit(None).cast("string"))),
    readers.missing_probe: lambda s, x: readers.missing_probe(x),
    gate.passed: lambda s, x: gate.passed(x),
    gate.live_only: lambda s, x: gate.live_only(vecs(s), x),
}
COUNTS = {  # (words or numbers that only items in review would make)
    reports.word_counts: (lambda s, x: reports.word_counts(x, least=1).select("word"), {"gamma", "omega", "hold"}),
    reports.hashtag_counts: (lambda s, x: reports.hashtag_counts(x, rules(s)).select("tag"), {"three", "five"}),
    reports.storage_by_type: (lambda s, x: reports.storage_by_type(x).select("items"), {5}),
    reports.coverage_report: (lambda s, x: reports.coverage_report(x, {"all": (F.lit(True), F.lit(True))}).select("total"), {5}),
    tagging.train_centroids: (lambda s, x: tagging.train_centroids(x, vecs(s), table(s, "item_id long, tag string, verdict int", *((i, "t", 1) for i in range(1, 6)))).select("n_pos"), {5}),
}
ROUTED = {  # these keep items in review, with their review_state, or count them
    windows.mark_duplicates: lambda s, x: windows.mark_duplicates(x),
    windows.plan_names: lambda s, x: windows.plan_names(x.select("item_id", "path", *(c for c in x.columns if c == "review_state"), F.lit("mp4").alias("ext"), F.lit("single").alias("duplicate_role"), F.lit(None).cast("string").alias("probe_error"), F.lit("c").alias("category"), F.lit("20240101").alias("date_key"), F.lit("s").alias("slug"))),
    joins.fill_probes: lambda s, x: joins.fill_probes(x, none(s, "item_id long, probed_at timestamp, status string, width int, height int, duration double")),
    joins.delete_unseen: lambda s, x: joins.delete_unseen(x, items(s), "r"),
    reports.scan_summary: lambda s, x: reports.scan_summary(x.withColumns({"action": F.lit("keep"), "flags": F.array(), "duplicate": F.lit(False)})),
    gate.review_queue: lambda s, x: gate.review_queue(x, all_tags(s), "none", 10),
    gate.tombstone: lambda s, x: gate.tombstone(x, none(s)),
    gate.routed: lambda s, x: gate.routed(x),
}
NO_ITEMS = {  # they take tags, moves, scores, counts, files or queries, or are parts of those above
    *(gate.review_gate, gate.bounded, search.contains_text, joins.last_by, joins.trace_original, joins.movement_log, joins.incremental_only),
    *(reports.percent, reports.recommendations, reports.quality_gate, reports.gate_ok, reports.moves_rollup, reports.tag_stats, reports.tag_cooccurrence, reports.tags_concat),
    *(tagging.rule_words, tagging.import_labels, tagging.pool_label_scores, tagging.upsert_tags, tagging.last_feedback, tagging.feedback_audit, tagging.feedback_overlay, tagging.manual_tag, tagging.favorite_overlay, tagging.unit, tagging.centroid_status, tagging.dot, tagging.padded, tagging.centroid_scores),
    *(windows.similarity_listing, windows.timeline_segments, windows.first_k_signature, windows.frame_fingerprint),
    *(vectors.full_hash, vectors.hash8, vectors.partial_hash, vectors.dhash_bits, vectors.hash_bits_vector, vectors.token_place, vectors.row_vectors, vectors.hashed_text_vector, vectors.hashed_texts, vectors.new_vectors, vectors.top_products, vectors.best_of, vectors.local_products, vectors.import_vectors_into),
}


@pytest.mark.parametrize("view", list(VIEWS), ids=lambda f: f.__name__)
def test_lists_only_what_passed(spark, view):
    with pytest.raises(ValueError, match="review_gate"):
        VIEWS[view](spark, items(spark)).collect()
    got = {r["item_id"] for r in VIEWS[view](spark, gated(spark)).collect()}
    assert got and not got & REVIEW


@pytest.mark.parametrize("view", list(COUNTS), ids=lambda f: f.__name__)
def test_counts_only_what_passed(spark, view):
    run, hidden = COUNTS[view]
    with pytest.raises(ValueError, match="review_gate"):
        run(spark, items(spark)).collect()
    got = {r[0] for r in run(spark, gated(spark)).collect()}
    assert got and not got & hidden


@pytest.mark.parametrize("view", list(ROUTED), ids=lambda f: f.__name__)
def test_routes_only_what_was_gated(spark, view):
    with pytest.raises(ValueError, match="review_gate"):
        ROUTED[view](spark, items(spark)).collect()
    rows = ROUTED[view](spark, gated(spark)).collect()
    if "review_state" in rows[0]:
        assert {r["item_id"] for r in rows if r["review_state"] == "review"} == REVIEW
    elif view is windows.plan_names:
        assert {r["item_id"] for r in rows if r["route"] == "review"} == REVIEW
    else:
        assert rows[0]["items"] == 5


def test_every_public_function_is_listed():
    known = {*VIEWS, *COUNTS, *ROUTED, *NO_ITEMS}
    for module in (gate, search, joins, reports, tagging, windows, vectors):
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if f.__module__ == module.__name__ and not name.startswith("_") and not hasattr(f, "evalType"):
                assert f in known, f"{module.__name__}.{name}"
