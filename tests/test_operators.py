import hashlib
import struct
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.functions import names
from quillstack.operators import gate, joins, reports, search, tagging, vectors, windows
from quillstack.sources import readers

ITEM = "item_id long, root string, relative_path string, path string, filename string, media_type string, size_bytes long, sha256 string, mtime timestamp, text string"


def items(spark):
    at = datetime(2024, 1, 1)
    rows = [
        (1, "r1", "a/x.mp4", "r1/a/x.mp4", "x.mp4", "video", 10, "h1", at, "alpha"),
        (2, "r1", "a/y.mp4", "r1/a/y.mp4", "y.mp4", "video", 10, "h1", at, "beta"),
        (3, "r2", "z.jpg", "r2/z.jpg", "z.jpg", "photo", 5, "ERR_1", at, "hold this"),
        (4, "r2", "w.jpg", "r2/w.jpg", "w.jpg", "photo", 5, "ERR_1", at, None),
        (5, "r2", "v.bin", "r2/v.bin", "v.bin", None, None, None, None, "hold this"),
    ]
    return spark.createDataFrame(rows, ITEM)


def gated(spark, **more):
    return gate.review_gate(items(spark), spark.createDataFrame([("r", "hold")], "name string, pattern string"), "text", **more)


def ids(df):
    return sorted(r["item_id"] for r in df.select("item_id").collect())


TAGS = "item_id long, tag string, category string, confidence double, source string, state string"


def tags(spark):
    return spark.createDataFrame([(1, "t", "c", 0.9, "keyword", "confirmed"), (2, "t", "c", 0.9, "keyword", "rejected"), (3, "t", "c", 0.9, "keyword", "confirmed"), (1, "u", "c", 0.5, "x", "pending")], TAGS)


def test_no_view_shows_review_items(spark):
    rows = gated(spark)
    assert ids(rows.where("review_state = 'review'")) == [3, 5]
    empty = spark.createDataFrame([], "item_id long, text string")
    vectors_ = spark.createDataFrame([(i, "image", "m", [1.0, float(i)]) for i in range(1, 6)], "item_id long, kind string, model string, vector array<double>")
    query = vectors_.where("item_id = 1").withColumnRenamed("item_id", "query_id")
    rules = spark.createDataFrame([(1, "c", "t", ["x", "y", "z", "w", "v"])], "rule_order int, category string, tag string, words array<string>")
    views = [
        search.catalog_query(rows, tags(spark), empty),
        search.catalog_query(rows, tags(spark), empty, text="hold"),
        search.catalog_query(rows, tags(spark), empty, page=(3, 10), show_tags=True),
        tagging.import_labels_by_path(rows.select(F.col("path").alias("media_path"), F.lit("l").alias("label"), F.lit("1").alias("score")), rows),
        search.recent_page(rows, 10),
        search.seeded_shuffle(rows, 3, 10),
        vectors.cosine_topk(rows, vectors_, query, 5),
        vectors.semantic_search(rows, vectors_, query, rows.select("item_id", "text"), 5, least=-9.0),
        search.manifest_search({"items": rows}, "2", 10),
        search.with_tag(rows, tags(spark), "t"),
        search.without_tag(rows, tags(spark), "none"),
        search.needs_timed_rerun(rows, empty, F.array(), F.lit(False)),
        search.low_confidence(rows, spark.createDataFrame([], "item_id long, score double")),
        joins.lookup_paths(rows, rows.select(F.col("filename").alias("wanted"))),
        joins.join_by_any_path(rows.select(F.col("relative_path").alias("media_path")), rows),
        joins.item_detail(rows, tags(spark), spark.createDataFrame([], "item_id long, start double, end double, label string"), spark.createDataFrame([], "item_id long, operation string, created_at timestamp"), empty),
        windows.similarity_index(rows, "k", F.lit("same")),
        tagging.keyword_tags(rows, rules),
        tagging.first_category(rows, rules, F.col("filename")),
        vectors.vector_index(rows, rows.withColumn("kind", F.lit("text")), spark.createDataFrame([], "item_id long, kind string, model string, text_hash string"), "m"),
    ]
    for v in views:
        assert not {3, 5} & set(ids(v))
    assert [n for n, v in enumerate(views) if not ids(v)] == [1]  # only review items hold that word
    words = {r["word"] for r in reports.word_counts(rows, least=1).collect()}
    assert "alpha" in words and "hold" not in words
    assert reports.storage_by_type(rows).where("media_type = 'photo'").first()["items"] == 1


def test_views_refuse_items_without_a_gate(spark):
    with pytest.raises(ValueError, match="review_gate"):
        search.recent_page(items(spark), 10)
    with pytest.raises(ValueError, match="over 1 rows"):
        gate.bounded(items(spark), 1, "rows")


def test_products_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i % 30, "image" if i % 2 else "text", "m", rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(60)]
    base = spark.createDataFrame(rows, "item_id long, kind string, model string, vector array<double>").repartition(3)
    queries = base.where("item_id < 12").withColumnRenamed("item_id", "query_id")
    want = {}
    for q, kind, _, v in rows:
        for i, other, _, w in rows:
            if q < 12 and kind == other and i != q:
                want.setdefault(q, {})[i] = max(want.get(q, {}).get(i, -99), float(np.dot(v, w)) * (1.0 if kind == "image" else 0.75))
    want = {(q, i, s) for q, own in want.items() for i, s in sorted(own.items(), key=lambda x: (-x[1], -x[0]))[:3]}
    for most in (10_000, 5):
        monkeypatch.setattr(vectors, "MOST_QUERIES", most)
        got = vectors.top_products(base, queries, 3, {"image": 1.0}, 0.75)
        assert {(r["query_id"], r["item_id"], r["score"]) for r in got.collect()} == want


def test_only_a_verdict_clears_review(spark):
    verdicts = spark.createDataFrame([(3, True), (5, False)], "item_id long, cleared boolean")
    assert ids(gate.passed(gated(spark, verdicts=verdicts))) == [1, 2, 3, 4]
    none = gate.review_gate(items(spark), spark.createDataFrame([], "name string, pattern string"), "text")
    assert none.where("review_state = 'review'").count() == 0


def test_queue_and_tombstone(spark):
    rows = gate.tombstone(gated(spark), spark.createDataFrame([(5,)], "item_id long"))
    assert ids(gate.review_queue(rows, tags(spark), "u", 10)) == [1, 3]
    assert ids(gate.passed(rows)) == [1, 2, 4]


def test_duplicates_ignore_errors_and_nulls(spark):
    rows = windows.mark_duplicates(gated(spark)).collect()
    assert {r["item_id"]: r["review_state"] for r in rows}[5] == "review"
    got = {r["item_id"]: r["duplicate_role"] for r in rows}
    assert got == {1: "keep", 2: "candidate", 3: "single", 4: "single", 5: "single"}


def test_plan_prefers_review_over_duplicate(spark):
    schema = "item_id long, path string, ext string, review_state string, duplicate_role string, probe_error string, category string, date_key string, slug string"
    rows = [(1, "a", "mp4", "review", "candidate", None, "c", "20240102_000000", "s"), (2, "b", "mp4", "normal", "candidate", None, "c", "20240102_000000", "s"), (3, "c", "mp4", "normal", "keep", None, None, "20240102_000000", "s"), (4, "d", "mp4", "normal", "keep", None, None, "20240102_000000", "s")]
    got = {r["item_id"]: (r["route"], r["target"]) for r in windows.plan_names(spark.createDataFrame(rows, schema)).collect()}
    assert got[1][0] == "review" and got[2][0] == "duplicates"
    assert got[3][1] == "by_month/2024-01/20240102_000000_s.mp4" and got[4][1] == "by_month/2024-01/20240102_000000_s_002.mp4"


def test_similarity_skips_empty_signatures(spark):
    rows = spark.createDataFrame([(1, 5, "", "a"), (2, 6, "", "b"), (3, 1, "s", "a"), (4, 9, "s", "z"), (5, 9, "s", "c"), (6, None, "s", "0")], "item_id long, size_bytes long, sig string, path string").withColumn("review_state", F.lit("normal"))
    got = {r["item_id"]: r["role"] for r in windows.similarity_index(rows, "k", F.col("sig")).collect()}
    assert got == {3: "candidate", 4: "candidate", 5: "keep", 6: "candidate"}  # of the largest, the first path
    listing = windows.similarity_listing(windows.similarity_index(rows, "k", F.col("sig")), 5)
    assert [r["item_id"] for r in listing.orderBy("position").collect()] == [5, 4, 3, 6]


def test_timeline(spark):
    rows = spark.createDataFrame([(1, ["a", "", "c"], [0.0, None, 7.5])], "item_id long, refs array<string>, times array<double>")
    segments = windows.timeline_segments(rows)
    assert [(r["start"], r["end"]) for r in segments.orderBy("idx").collect()] == [(0.0, 7.0), (7.0, 8.0), (7.5, 14.5)]
    assert windows.first_k_signature(segments, 1).first()["signature"] == "a"


def test_trace_follows_moves_and_survives_cycles(spark):
    moves = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("x", "c", 3), ("p", "q", 1), ("q", "p", 2)], "source string, dest string, seq int")
    got = {r["path"]: (r["origin"], r["hops"]) for r in joins.trace_original(spark.createDataFrame([("c",), ("q",), ("z",)], "path string"), moves).collect()}
    assert got == {"c": ("a", 2), "q": ("p", 1), "z": ("z", 0)}


def test_delete_unseen_is_scoped_to_its_root(spark):
    seen = spark.createDataFrame([("r1/a/x.mp4",)], "path string")
    assert ids(joins.delete_unseen(gated(spark), seen, "r1")) == [1, 3, 4, 5]


def test_original_names(spark):
    rows = spark.createDataFrame([(1, "own name.mp4"), (2, "VID_20240101_x_deadbeef.mp4"), (3, None)], "item_id long, original_name string").withColumn("review_state", F.lit("normal"))
    traced = spark.createDataFrame([(1, "t1"), (2, "t2")], "item_id long, traced_name string")
    got = {r["item_id"]: r["original_name"] for r in joins.prefer_original_name(rows, traced, names.is_normalized_name).collect()}
    assert got == {1: "own name.mp4", 2: "t2", 3: None}


def test_paths(spark):
    wanted = spark.createDataFrame([("x.mp4",), ("r2/z.jpg",), ("nothing",)], "wanted string")
    assert ids(joins.lookup_paths(gated(spark), wanted)) == [1]
    rows = spark.createDataFrame([("a\\y.mp4",), ("r2/z.jpg",)], "media_path string")
    assert ids(joins.join_by_any_path(rows, gated(spark))) == [2]


def test_tags_search_and_stats(spark):
    assert ids(search.with_tag(gated(spark), tags(spark), "t")) == [1]
    assert ids(search.without_tag(gated(spark), tags(spark), "t")) == [2, 4]
    assert {r["item_id"]: r["tags"] for r in reports.tags_concat(tags(spark)).collect()} == {1: "t,u", 3: "t"}
    assert [tuple(r) for r in reports.tag_cooccurrence(tags(spark), 5, 1, 5).collect()] == [("t", "u", 1)]
    text = spark.createDataFrame([(4, "100% of it")], "item_id long, text string")
    assert ids(search.free_text(gated(spark), tags(spark), text, "100%", ["filename"])) == [4]


def test_feedback_and_manual_tags(spark):
    at = datetime(2024, 1, 1)
    feedback = spark.createDataFrame([(1, "t", "c", -1, at), (4, "n", "c", 1, at)], "item_id long, tag string, category string, verdict int, updated_at timestamp")
    got = {(r["item_id"], r["tag"]): (r["source"], r["state"]) for r in tagging.feedback_overlay(tags(spark), feedback).collect()}
    assert got[1, "t"] == ("keyword", "rejected") and got[4, "n"] == ("manual", "confirmed") and got[1, "u"] == ("x", "pending")
    wanted = spark.createDataFrame([(1, True), (2, False)], "item_id long, on boolean")
    once = tagging.favorite_overlay(tags(spark), wanted)
    assert ids(tagging.favorite_overlay(once, wanted).where("tag = 'favourite'")) == [1]


def test_pooled_scores(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 1, 0.6), (1, "b", 2, 0.8), (1, "b", 3, 0.7)], "item_id long, label string, frame int, score double")
    got = tagging.pool_label_scores(rows).first()
    assert (got["label"], got["frame"]) == ("a", 1) and abs(got["score"] - 0.9 * (0.75 + 0.25 / 3)) < 1e-9


def test_centroids(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "item_id long, vector array<double>")
    f = spark.createDataFrame([(1, "t", 1), (2, "t", 1), (3, "t", -1), (3, "one", 1)], "item_id long, tag string, verdict int")
    live = spark.createDataFrame([(i, "normal") for i in (1, 2, 3)], "item_id long, review_state string")
    c = tagging.train_centroids(live, v, f)
    assert [(r["tag"], r["threshold"], r["n_pos"], r["n_neg"]) for r in c.collect()] == [("t", 0.62, 2, 1)]
    assert ids(tagging.apply_centroids(live, v, c)) == [1, 2]


def test_coverage_and_gate(spark):
    got = {r["id"]: r for r in reports.coverage_report(gated(spark), {"all": (F.lit(True), F.col("text").isNotNull()), "none": (F.lit(False), F.lit(True))}).collect()}
    assert (got["all"]["ready"], got["none"]["percent"]) == (2, 0)  # of items that passed
    c = spark.createDataFrame([("a", 10, 80), ("b", 0, 0)], "id string, total long, percent int")
    m = spark.createDataFrame([("a", 90), ("b", 90), ("c", 50)], "id string, minimum int")
    gate_ = reports.quality_gate(c, m)
    assert {r["id"]: r["passed"] for r in gate_.collect()} == {"a": False, "b": True, "c": True}
    assert reports.gate_ok(gate_).first()["ok"] is False


def test_vectors_round_trip(spark):
    rows = spark.createDataFrame([([1.0, 2.5],), (None,)], "v array<double>")
    packed = rows.select(vectors.pack_vector("v").alias("b"))
    assert [bytes(r["b"]) for r in packed.collect()] == [struct.pack("<2f", 1.0, 2.5), b""]
    for dim, want in ((2, [1.0, 2.5]), (1, [1.0]), (3, []), (0, []), (None, [])):
        back = packed.select(vectors.unpack_vector("b", F.lit(dim).cast("int")).alias("v")).collect()
        assert [r["v"] for r in back] == [want, []]
    blake = spark.createDataFrame([(["a", "b"],)], "t array<string>").select(vectors.hashed_text_vector_blake2b("t").alias("v")).first()["v"]
    assert abs(sum(x * x for x in blake) - 1) < 1e-9


def test_manifest_and_vector_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿path,size\na\x00b,1\n", encoding="utf-8")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("gone", T.StringType())])
    assert [tuple(r) for r in readers.read_manifest_csv(spark, str(tmp_path / "m.csv"), schema).collect()] == [("ab", 1, None)]
    assert readers.read_manifest_csv(spark, str(tmp_path / "none.csv"), schema).count() == 0
    (tmp_path / "v.jsonl").write_text('{"media_path":"a","embedding":[1.0]}\nbroken\n{"media_path":"a","embedding":[2.0]}\n{"media_path":"b","embedding":[]}\n')
    assert [(r["media_path"], r["embedding"]) for r in readers.read_vectors_jsonl(spark, str(tmp_path / "v.jsonl")).collect()] == [("a", [2.0])]
    (tmp_path / "lib" / "skip").mkdir(parents=True)
    (tmp_path / "lib" / "a.mp4").write_bytes(b"abc")
    (tmp_path / "lib" / "skip" / "b.mp4").write_bytes(b"x")
    found = readers.scan_files(spark, str(tmp_path / "lib"), ["mp4"], ["skip"]).collect()
    assert [(r["ext"], r["size_bytes"]) for r in found] == [("mp4", 3)]
    readers.append_audit(items(spark), "scan", str(tmp_path / "audit"))
    readers.append_audit(items(spark), "scan", str(tmp_path / "audit"), write=lambda df: df.write.parquet(str(tmp_path / "out")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert [r["rows"] for r in spark.read.parquet(str(tmp_path / "audit")).collect()] == [5, 5]


def test_catalog_query_conditions(spark):
    rows = gated(spark).withColumn("resolution", F.when(F.col("item_id") == 1, "1920x1080")).withColumn("quality", F.when(F.col("item_id") == 2, "1080P"))
    empty = spark.createDataFrame([], "item_id long, text string")
    found = lambda **how: search.catalog_query(rows, tags(spark), empty, **how)
    assert ids(found(resolution="1080")) == [1, 2]
    assert ids(found(favourite="t")) == [1] and ids(found(without="t")) == [2, 4]
    assert {r["item_id"]: r["tags"] for r in found(show_tags=True).collect()} == {1: "t,u", 2: None, 4: None}
    assert found(page=(5, 2)).count() == 2 and found(page=(5, 9)).collect() == found(page=(5, 9)).collect()
    with pytest.raises(ValueError):
        found(tag_terms=["a"] * 7)


def test_labels_by_path(spark):
    rows = spark.createDataFrame([("a/x.mp4", "one", "0.9"), ("r2/w.jpg", "two", "bad"), ("a\\y.mp4", "one", "0.2"), ("r1/a/y.mp4", "one", "0.7"), ("z.jpg", "held", "1"), ("nowhere", "one", "1"), (None, "one", "1")], "media_path string, label string, score string")
    got = tagging.import_labels_by_path(rows, gated(spark)).select("item_id", "tag", "confidence", "state").collect()
    assert sorted(tuple(r) for r in got) == [(1, "one", 0.9, "confirmed"), (2, "one", 0.7, "confirmed"), (4, "two", 0.0, "pending")]


def test_missing_and_filled(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "item_id long, sha256 string").withColumn("review_state", F.lit("normal"))
    assert ids(readers.missing_hash(rows)) == [2, 3]
    probes = spark.createDataFrame([(1, 5, 7), (2, None, 7), (3, None, None)], "item_id long, probed int, old int")
    assert [r[0] for r in probes.orderBy("item_id").select(names.fill_probe(F.col("probed"), F.col("old"))).collect()] == [5, 7, None]


def test_fill_probes(spark):
    """The last good probe counts, null and zero sides make no resolution, and items in review stay so."""
    rows = spark.createDataFrame([(i, "review" if i == 4 else "normal", 1, 2, 3.0, "1x2") for i in range(1, 6)], "item_id long, review_state string, width int, height int, duration double, resolution string")
    at = [datetime(2024, 1, day) for day in (1, 2, 3)]
    found = [(1, at[0], "ok", 9, 9, 9.0), (1, at[1], "partial", 5, None, 6.0), (1, at[2], "failed", 7, 7, 7.0), (2, at[0], "ok", 0, 4, None), (3, at[0], "ok", 6, 8, None), (3, at[0], "ok", 6, 8, None), (4, at[0], "ok", 6, 8, 1.5), (9, at[0], "ok", 1, 1, 1.0)]
    probes = spark.createDataFrame(found, "item_id long, probed_at timestamp, status string, width int, height int, duration double")
    got = {r["item_id"]: tuple(r)[1:] for r in joins.fill_probes(rows, probes).select("item_id", "review_state", "width", "height", "duration", "resolution").collect()}
    assert got == {1: ("normal", 5, 2, 6.0, "1x2"), 2: ("normal", 0, 4, 3.0, "1x2"), 3: ("normal", 6, 8, 3.0, "6x8"), 4: ("review", 6, 8, 1.5, "6x8"), 5: ("normal", 1, 2, 3.0, "1x2")}
    assert joins.fill_probes(rows.drop("resolution"), probes.limit(0)).where("resolution is null").count() == 5


def test_partial_hash_of_large_contents(spark):
    """Over two megabytes the last one counts as well; what lies between does not."""
    mb = 1 << 20
    contents = [b"", b"a" * 10, b"a" * mb + b"b" * mb, b"a" * mb + b"b" * mb + b"c", b"a" * mb + b"x" * 9 + b"c" * mb, b"a" * mb + b"y" * 9 + b"c" * mb]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "i int, content binary")
    got = [r["h"] for r in rows.orderBy("i").select(vectors.partial_hash(F.col("content")).alias("h")).collect()]
    want = [hashlib.sha256(c[:mb] + (c[-mb:] if len(c) > 2 * mb else b"") + str(len(c)).encode()).hexdigest() for c in contents]
    assert got == want and len(set(got)) == 5


def test_last_line_of_many_blocks(spark, tmp_path):
    """The last line of a path wins, also where a file is read in many blocks."""
    lines = [f'{{"media_path":"p{i % 7}","model":"m","pretrained":"p","embedding":[{i}.0]}}' for i in range(2000)]
    (tmp_path / "v.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {r["media_path"]: r["embedding"][0] for r in readers.read_vectors_jsonl(spark, str(tmp_path / "v.jsonl")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"p{i % 7}": float(i) for i in range(1993, 2000)}
