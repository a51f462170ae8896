"""The catalog's own mechanisms against brute force: rule words, chains, text vectors, centroids, frames, files and counts."""

import hashlib
import random
import re
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.operators import batches, joins, reports, tagging, vectors, windows
from quillstack.plans import catalog
from quillstack.sources import readers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_rule_words_by_brute_force(spark):
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abAB éß#_") for _ in range(n))
    rows = [(i, text(r.randint(0, 8)), text(r.randint(0, 60))) for i in range(60)] + [(60, None, "ab"), (61, "ab", None), (62, "", ""), (63, "x", "ab" * 30_000)]
    rules = [(k, f"c{k % 4}", f"t{k % 5}", [text(r.randint(1, 3)) for _ in range(r.randint(0, 3))]) for k in range(12)] + [(12, "c9", "t9", ["ab", "AB", "b", None]), (13, "c8", "t8", None), (14, "c7", "t7", ["", "zz"])]
    items = spark.createDataFrame(rows, "item_id long, filename string, text string").withColumn("review_state", F.lit("normal"))
    table = spark.createDataFrame(rules, "rule_order int, category string, tag string, words array<string>")
    want, first = {}, {}
    for i, name, body in rows:
        low = ((name or "").lower(), (body or "").lower())
        for order, category, tag, words in rules:
            for w in words or ():
                if w is None:
                    continue
                if any(w.lower() in x for x in low):
                    best, cats = want.get((i, tag), (0, set()))
                    want[i, tag] = max(best, 0.92 if w.lower() in low[0] else 0.78), cats | {category}
                if w.lower() in low[1]:
                    first[i] = min(first.get(i, (99, "")), (order, category))
    found = tagging.keyword_tags(items, table)
    assert {(x["item_id"], x["tag"]): (x["confidence"], x["category"]) for x in found.collect()} == {k: (c, min(cats)) for k, (c, cats) in want.items()}
    assert {x["item_id"]: x["category"] for x in tagging.first_category(items, table, F.coalesce("text", F.lit(""))).collect()} == {i: c for i, (_, c) in first.items()}
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert tagging.keyword_tags(items, table.limit(0)).count() == 0 == tagging.keyword_tags(items.limit(0), table).count()
    tags = reports.hashtag_counts(items, table)
    assert "NestedLoop" not in plan(tags)
    for x in tags.collect():
        hits = [(o, c) for o, c, _, words in rules for w in words or () if w is not None and w.lower() in x["tag"]]
        assert x["category"] == (min(hits)[1] if hits else "noise")


def followed(start, first, most):
    seen = [start]
    while len(seen) <= most and (at := first.get(seen[-1])) is not None and at not in seen:
        seen.append(at)
    return seen[-1], len(seen) - 1


@pytest.mark.parametrize("most", [1, 3, 16, 20])
def test_chains_by_brute_force(spark, most):
    r = random.Random(most)
    moves = [(f"n{i - 1}", f"n{i}", 1) for i in range(1, 40)]  # longer than any limit
    moves += [(f"c{(i + 1) % 17}", f"c{i}", 1) for i in range(17)] + [("c0", "tail1", 1), ("tail1", "tail2", 1), ("self", "self", 1)]  # a ring, a way into it
    moves += [(f"r{r.randrange(30)}", f"r{r.randrange(30)}", i) for i in range(40)] + [(None, "x", 1), ("x", None, 1)]
    first = {}
    for source, dest, seq in sorted((m for m in moves if None not in m), key=lambda m: (m[2], m[0])):
        first.setdefault(dest, source)
    paths = sorted({p for m in moves for p in m[:2] if p}) + ["nowhere", "n5", None]
    got = joins.trace_original(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(moves, "source string, dest string, seq int"), most)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((p, *(followed(p, first, most) if p else (None, 0))) for p in paths), key=str)


def test_chains_without_moves(spark):
    got = joins.trace_original(spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([], "source string, dest string, seq int"))
    assert [tuple(r) for r in got.collect()] == [("a", "a", 0)]


def vector_of(tokens, dim):
    out = np.zeros(dim)
    for t in tokens:
        d = hashlib.md5(t.encode()).digest()
        out[int.from_bytes(d[:4], "big") % dim] += 1 if d[4] % 2 else -1
    return out / (np.linalg.norm(out) or 1)


def test_text_vectors_by_brute_force(spark):
    texts = ["One two TWO three", "_a_ -bb- __c__ d", "é" * 60 + " ß", "", None, "x", "日本語 текст 12 a1", "word " * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = vectors.hashed_texts(rows, dim=32)
    assert "Exchange" not in plan(got)
    words = {i: [w for w in (x.strip("_-")[:48] for x in re.findall(r"[\w-]+", (t or "").lower())) if len(w) > 1] for i, t in enumerate(texts)}
    assert {r["item_id"] for r in got.collect()} == {i for i, w in words.items() if w}
    assert all(np.allclose(r["vector"], vector_of(words[r["item_id"]], 32)) for r in got.collect())
    listed = spark.createDataFrame([(i, w) for i, w in words.items()] + [(99, None), (98, ["a", None])], "item_id long, tokens array<string>")
    by = {r["item_id"]: r["vector"] for r in vectors.hashed_text_vector(listed, "tokens", "item_id", 32).collect()}
    assert set(by) == {i for i, w in words.items() if w} | {98} and all(np.allclose(v, vector_of(words.get(i, ["a"]), 32)) for i, v in by.items())


def test_token_memory_is_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(20)], "item_id long, text string")
    want = {r["item_id"]: r["vector"] for r in vectors.hashed_texts(rows).collect()}
    monkeypatch.setattr(vectors, "KNOWN", 3)
    assert {r["item_id"]: r["vector"] for r in vectors.hashed_texts(rows).collect()} == want


@pytest.mark.parametrize("block", [1000, 2])
def test_centroids_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(tagging, "CENTROIDS", block)
    r = np.random.default_rng(6)
    v = [(i, r.normal(size=n).tolist()) for i, n in enumerate([4] * 20 + [2, 6, 0, 4])] + [(30, None), (31, [1.0, None, 2.0, 0.5]), (32, [9.0] * 4)]
    c = [(f"t{k}", r.normal(size=n).tolist(), None if k % 3 == 0 else r.normal(size=m).tolist(), 0.3 + 0.1 * k) for k, (n, m) in enumerate([(4, 4), (4, 4), (3, 4), (6, 2), (4, 4)])]
    pad = lambda x: np.array([y or 0.0 for y in x or ()] + [0.0] * (9 - len(x or ())))
    want = {}
    for i, x in v:
        for tag, p, n, least in c:
            if x is not None and i != 32:
                s = 1 / (1 + np.exp(-np.clip(8 * (pad(x) @ pad(p) - pad(x) @ pad(n)), -60, 60)))
                if s >= least:
                    want[i, tag] = s, "confirmed" if s >= 0.76 else "pending"
    items = spark.createDataFrame([(i, "review" if i == 32 else "normal") for i, _ in v], "item_id long, review_state string")
    got = tagging.apply_centroids(items, spark.createDataFrame(v, "item_id long, vector array<double>"), spark.createDataFrame(c, "tag string, positive array<double>, negative array<double>, threshold double"))
    found = {(x["item_id"], x["tag"]): (x["confidence"], x["state"]) for x in got.collect()}
    assert set(found) == set(want) and all(abs(found[k][0] - want[k][0]) < 1e-12 and found[k][1] == want[k][1] for k in want)
    assert "NestedLoop" not in plan(got)


def test_matrices_of_lists():
    import pyarrow as pa

    column = pa.array([[1, 2], None, [3], [4, None], []], pa.list_(pa.float32())).slice(1)
    got = {m.shape[1]: (rows.tolist(), m.tolist()) for rows, m in batches.matrices(column)}
    assert got == {0: ([3], [[]]), 1: ([1], [[3.0]]), 2: ([2], [[4.0, 0.0]])}


def test_frame_fingerprints(spark):
    r = np.random.default_rng(7)
    grids = [r.integers(0, 9, 72).astype(float).tolist() for _ in range(4)]
    hashed = [f"{sum(int(g[j // 8 * 9 + j % 8] > g[j // 8 * 9 + j % 8 + 1]) << 63 - j for j in range(64)):016x}" for g in grids]
    frames = [(1, 0, 5.0, grids[0]), (1, 1, 1.0, grids[1]), (1, 2, 1.0, grids[2]), (1, 3, 9.0, grids[3]), (2, 0, 0.0, None), (2, 1, 1.0, grids[0]), (3, 0, 0.0, [1.0]), (3, 1, 1.0, grids[3]), (4, 0, 0.0, [1.0])]
    got = windows.frame_fingerprint(spark.createDataFrame(frames, "item_id long, idx int, start double, luma array<double>"))
    assert {x["item_id"]: x["signature"] for x in got.collect()} == {1: "|".join([hashed[1], hashed[2], hashed[0]]), 2: hashed[0], 3: hashed[3]}


@pytest.mark.parametrize("most", [0, windows.SMALL_PICTURES])
def test_shared_pictures_are_hashed_once(spark, monkeypatch, most):
    """The same signatures as with a grid in each frame, by the broadcast and by the shuffled join, and no grid beside a frame."""
    monkeypatch.setattr(windows, "SMALL_PICTURES", most)
    grids = [*np.random.default_rng(8).integers(0, 9, (3, 72)).astype(float).tolist(), [1.0], None]
    rows = [(i, n, float(n * 7 % 5), (i * 3 + n) % 6) for i in range(20) for n in range(i % 7)]
    shots = spark.createDataFrame(rows, "item_id long, idx int, start double, picture int")
    pictures = spark.createDataFrame(list(enumerate(grids)), "picture int, luma array<double>")
    whole = windows.frame_fingerprint(shots.join(pictures, "picture").drop("picture"))
    got = windows.frame_fingerprint(shots, pictures=pictures)
    assert "luma" not in plan(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() > 5
    frames, few = catalog.frames(spark, "/root/testdata/sf0.001")
    assert "luma" not in frames.columns and few.count() <= 4


def test_feedback_by_category(spark):
    at = lambda d: datetime(2024, 1, d)
    tags = spark.createDataFrame([(i, t, "old", 0.9, s, "confirmed") for i in (1, 2, 3, 4) for t in ("a", "b") for s in ("keyword", "manual")], "item_id long, tag string, category string, confidence double, source string, state string")
    feedback = [(1, "a", "x", 1, "yes ", at(1)), (1, "a", "y", -1, None, at(2)), (2, "a", "x", -1, "", at(1)), (2, "a", "y", 5, "n", at(2)), (3, "a", "x", -1, "", at(1)), (3, "a", "x", 1, "changed", at(2)), (4, " ", "x", 1, "", at(1)), (5, " new ", None, 1, "", at(1))]
    table = spark.createDataFrame(feedback, "item_id long, tag string, category string, verdict int, note string, updated_at timestamp")
    got = {(r["item_id"], r["tag"], r["source"]): (r["category"], r["state"]) for r in tagging.feedback_overlay(tags, table).collect()}
    assert got[1, "a", "keyword"] == ("old", "rejected") and got[1, "a", "manual"] == ("x", "rejected")
    assert got[2, "a", "keyword"] == ("old", "rejected") and got[2, "a", "manual"] == ("y", "confirmed")
    assert got[3, "a", "keyword"] == ("old", "confirmed") and got[3, "a", "manual"] == ("x", "confirmed")
    assert got[5, "new", "manual"] == ("", "confirmed") and got[4, "b", "manual"] == ("old", "confirmed") and len(got) == 17
    assert {(r["item_id"], r["category"]): (r["verdict"], r["note"]) for r in tagging.last_feedback(table).where("item_id in (1, 3)").collect()} == {(1, "x"): (1, "yes"), (1, "y"): (-1, None), (3, "x"): (1, "changed")}
    assert sorted(r["detail"] for r in tagging.feedback_audit(table).where("item_id = 3").collect()) == ["a=-1", "a=1"]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_few_words_without_python(spark, monkeypatch, most):
    """By `contains` and by the automaton the same words, as brute force finds them."""
    monkeypatch.setattr(batches, "FEW_WORDS", most)
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abé#_ 字\x00") for _ in range(n))
    rows = [(i, text(r.randint(0, 6)), text(r.randint(0, 40))) for i in range(50)] + [(50, None, "ab"), (51, "ab", None), (52, "", ""), (53, None, None), (54, "x", "ab" * 30_000)]
    table = spark.createDataFrame(rows, "id long, a string, b string")
    for words in ([], [""], ["ab"], ["ab", "b", "ab", "", "字", "a%", "_", "\x00"], [text(r.randint(1, 3)) for _ in range(40)]):
        got = batches.found_words(table, "id", ("a", "b"), words)
        assert dict(got.dtypes) == {"id": "bigint", "word": "string", "place": "int"}
        assert sorted(map(tuple, got.collect())) == sorted((i, w, p) for i, *texts in rows for p, t in enumerate(texts) if t is not None for w in set(words) if w in t)
        assert ("MapInArrow" in plan(got)) == (not 0 < len(set(words)) <= most)


def test_catalog_query_sends_no_text_to_python(spark):
    assert "InArrow" not in plan(catalog.catalog_query(spark, "/root/testdata/sf0.001"))


def test_import_counts_come_from_the_write(spark, tmp_path):
    lines = ['{"media_path":"p1","model":"m","embedding":[3.0,4.0]}', "broken", "", '{"media_path":"p1","model":"m","embedding":[0.0,2.0]}', '{"media_path":"p2","model":"m","embedding":[]}', '{"media_path":"gone","model":"m","embedding":[1.0]}', '{"media_path":"p3","model":"m","embedding":[1.0]}', '{"media_path":"held","model":"m","embedding":[1.0]}', '{"media_path":"p4","model":"m","embedding":["x"]}', '{"media_path":"p4","model":"m","embedding":[null]}']
    (tmp_path / "v.jsonl").write_text("\n".join(lines) + "\n")
    rows = readers.read_vectors_jsonl(spark, str(tmp_path / "v.jsonl"), broken=True)
    items = spark.createDataFrame([(1, "p1", "normal"), (2, "p2", "normal"), (3, "p3", "normal"), (4, "p4", "normal"), (5, "held", "review")], "item_id long, path string, review_state string")
    done = spark.createDataFrame([(3, "m")], "item_id long, model string")
    tracker, group = spark.sparkContext.statusTracker(), "import"
    spark.sparkContext.setJobGroup(group, "one import")
    counts = vectors.import_vectors_into(items, rows, done, str(tmp_path / "vectors"), str(tmp_path / "audit"))
    assert counts == {"imported": 1, "skipped": 1, "failed": 6}  # broken, empty, unknown and held paths, two without numbers
    spark.sparkContext.setJobGroup("other", "")
    assert tracker.getJobIdsForGroup(group)
    assert [(r["item_id"], r["vector"]) for r in spark.read.parquet(str(tmp_path / "vectors")).collect()] == [(1, [0.0, 1.0])]
    audit = spark.read.parquet(str(tmp_path / "audit")).first()
    assert (audit["operation"], audit["rows"], audit["detail"]) == ("import_vectors", 8, "imported=1 skipped=1 failed=6")
    plain = readers.read_vectors_jsonl(spark, str(tmp_path / "v.jsonl"))
    assert sorted(r["media_path"] for r in plain.collect() if r["embedding"][0] is not None) == ["gone", "held", "p1", "p3"]
    with pytest.raises(ValueError, match="review_gate"):
        vectors.import_vectors_into(items.drop("review_state"), rows, done, str(tmp_path / "no"), str(tmp_path / "no"))


def mounted(spark, folder: Path) -> str:
    """The folder behind a scheme that only Spark's file system can open."""
    name = re.sub("[^a-z0-9]", "", folder.name.lower())  # file systems are kept by name
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{folder}")
    return f"viewfs://{name}/in"


@pytest.mark.parametrize("large", [1 << 30, 10])
def test_files_are_hashed_behind_any_scheme(spark, tmp_path, large):
    r = random.Random(4)
    bodies = {"a": b"", "b": b"x", "c": b"0123456789\n", "d": b"\n\n\n" * 20, "e": r.randbytes(50_000), "f": readers.BOM + b"mark then text", "g": readers.BOM + b"mark\nand end\n", "h": b"\r\n" * 30, "sub/i": bytes(range(256)) * 40, "j": b"no line feed at all" * 9}
    (tmp_path / "sub").mkdir()
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.hash_files(spark, mounted(spark, tmp_path), large).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r["path"].split("/in/")[1]: (r["size_bytes"], r["sha256"]) for r in got} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items() if b}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.hash_files(spark, str(tmp_path / "nothing")).collect()


@pytest.mark.parametrize("remote", [False, True])
def test_skipped_folders_are_not_opened(spark, tmp_path, remote):
    for name in ("a.mp4", "b/c.MP4", "b/d/e.jpg", "b/d/f.txt", "skip/g.mp4", "b/skip/h/i.mp4", "skipper/j.mp4", "b c/k.jpg", "empty/skip/l.mp4"):
        (tmp_path / "lib" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "lib" / name).write_bytes(b"123")
    root = mounted(spark, tmp_path) + "/lib" if remote else str(tmp_path / "lib")
    short = lambda rows: {r["path"].split("/lib/")[1] for r in rows}
    entries = short(readers.scan_entries(spark, root, ["skip"]).collect())
    assert {"skip", "b/skip", "empty/skip", "b/d"} <= entries and not any("skip/" in e for e in entries)
    found = readers.scan_files(spark, root, ["mp4", "jpg"], ["skip"]).collect()
    assert short(found) == {"a.mp4", "b/c.MP4", "b/d/e.jpg", "skipper/j.mp4", "b c/k.jpg"}
    assert {(r["ext"], r["size_bytes"]) for r in found} == {("mp4", 3), ("jpg", 3)} and all(abs(r["mtime"].timestamp() - (tmp_path / "lib" / "a.mp4").stat().st_mtime) < 100_000 for r in found)
