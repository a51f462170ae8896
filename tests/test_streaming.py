import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstack.streaming import ingest

SCHEMA = "item_id long, filename string, text string"


def test_ingest_goes_on_from_its_checkpoint(spark, tmp_path):
    rules = spark.createDataFrame([(1, "c", "t", ["word"])], "rule_order int, category string, tag string, words array<string>")
    review = spark.createDataFrame([("r", "hold")], "name string, pattern string")
    seen: list[tuple] = []

    def sink(items, tags, number):
        seen.append((sorted(r["item_id"] for r in items.collect()), sorted(r["item_id"] for r in tags.collect())))

    def run():
        q = ingest.ingest_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, rules, review, sink, str(tmp_path / "cp"))
        q.awaitTermination()

    spark.createDataFrame([(1, "hold word", "word"), (2, "ok", "word")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    run()
    spark.createDataFrame([(3, "x", "word")], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    run()
    assert seen == [([1, 2], [2]), ([3], [3])]


def test_dedupe_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(at, "video", 1, "h"), (at + timedelta(minutes=1), "video", 1, "h"), (at, "video", 2, "h")]
    spark.createDataFrame(rows, "ts timestamp, media_type string, size_bytes long, sha256 string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, media_type string, size_bytes long, sha256 string").parquet(str(tmp_path / "in"))
    q = ingest.dedupe_stream(stream, "ts").writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deduped").count() == 2


def test_ingest_rate_drops_late_rows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    schema = "ts timestamp, outcome string"
    for i, rows in enumerate([[(at, "processed"), (at + timedelta(minutes=1), "failed")], [(at + timedelta(hours=3), "processed")], [(at, "processed"), (at + timedelta(hours=6), "processed")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = ingest.ingest_rate(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    first = spark.read.parquet(str(tmp_path / "out")).orderBy("start").first()
    assert (first["processed"], first["failed"]) == (1, 1)


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    items = lambda *rows: spark.createDataFrame(list(rows), "item_id long, name string, at int").withColumn("review_state", F.lit("normal"))
    tags = lambda *rows: spark.createDataFrame(list(rows), "item_id long, tag string")
    state = lambda: (sorted((r["item_id"], r["name"]) for r in ingest.current_items(spark, folder).collect()), sorted(map(tuple, ingest.current_tags(spark, folder).collect())))
    assert ingest.current_items(spark, folder) is None and ingest.current_tags(spark, folder) is None
    assert ingest.upsert_batch(items((1, "a", 1), (2, "old", 1), (2, "new", 2)), tags((1, "x"), (2, "y")), 0, folder, ["at"])
    first = [(1, "a"), (2, "new")], [(1, "x"), (2, "y")]
    assert state() == first
    assert not ingest.upsert_batch(items((9, "other", 1)), tags(), 0, folder)
    assert state() == first

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # between the tables and the mark: nobody sees the batch
        m.setattr(ingest.commits, "mark", killed)
        with pytest.raises(RuntimeError):
            ingest.upsert_batch(items((2, "lost", 3), (3, "lost", 3)), tags((2, "lost")), 1, folder)
    assert state() == first
    assert ingest.upsert_batch(items((2, "b", 3), (3, "c", 3)), tags((3, "z")), 1, folder)
    second = [(1, "a"), (2, "b"), (3, "c")], [(1, "x"), (3, "z")]
    assert state() == second
    with monkeypatch.context() as m:
        m.setattr(ingest.commits, "mark", killed)
        with pytest.raises(RuntimeError):
            ingest.compact(spark, folder)
    assert state() == second
    ingest.compact(spark, folder)
    assert state() == second and len(ingest.commits.numbers(spark, folder)) == 1
    assert not ingest.upsert_batch(items((1, "again", 9)), tags(), 1, folder) and state() == second
    assert ingest.upsert_batch(items((1, "later", 9)), tags(), 2, folder)
    assert state() == ([(1, "later"), (2, "b"), (3, "c")], [(3, "z")])


def test_ingest_into_a_folder(spark, tmp_path):
    rules = spark.createDataFrame([(1, "c", "t", ["word"])], "rule_order int, category string, tag string, words array<string>")
    review = spark.createDataFrame([("r", "hold")], "name string, pattern string")
    add = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    run = lambda cp: ingest.ingest_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, rules, review, str(tmp_path / "t"), str(tmp_path / cp)).awaitTermination()
    add((1, "hold word", "word"), (2, "ok", "word"))
    run("cp")
    add((2, "hold now", "word"), (3, "x", "word"))
    run("cp")
    got = ingest.current_items(spark, str(tmp_path / "t"))
    assert {r["item_id"]: r["review_state"] for r in got.collect()} == {1: "review", 2: "review", 3: "normal"}
    assert [r["item_id"] for r in ingest.current_tags(spark, str(tmp_path / "t")).collect()] == [3]


FILES = "root string, path string, size_bytes long, mtime timestamp"


def test_watch_keeps_the_last_signatures(spark, tmp_path, monkeypatch):
    at = datetime(2024, 1, 1)
    rows = [("r1", "a", 1, at), ("r1", "b", 2, at), ("r2", "a", 1, at), (None, "n", None, None)]
    look = lambda *more: {(r["root"], r["change"], r["files"]) for r in ingest.watch(spark.createDataFrame([*rows, *more], FILES), str(tmp_path / "w")).collect()}
    assert look() == {("r1", "new", 2), ("r2", "new", 1), (None, "new", 1)}
    assert look() == set()
    rows[0] = ("r1", "a", 1, at + timedelta(seconds=1))
    assert look(("r3", "c", 5, at)) == {("r1", "changed", 2), ("r3", "new", 1)}
    with monkeypatch.context() as m:
        m.setattr(ingest.commits, "mark", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            look()
    assert look() == {("r3", "gone", 1)}
    rows[1] = ("r1", "c", 2, at)  # same count, bytes and time
    assert look() == {("r1", "changed", 2)}


def test_watch_signature_ignores_order(spark):
    rows = spark.createDataFrame([("a", 1, datetime(2024, 1, 1)), ("b", 2, datetime(2024, 1, 2)), ("c", None, None)], "path string, size_bytes long, mtime timestamp")
    a, b = (ingest.watch_signature(x).first() for x in (rows, rows.orderBy(F.desc("path"))))
    assert a == b and ingest.watch_signature(rows.limit(0)).first()["files"] == 0
    texts = [f"{p}|{s}|{t}" for p, s, t in (("a", 1, 1704067200), ("b", 2, 1704153600), ("c", "", ""))]
    assert a["digest"] == str(sum(int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in texts))
