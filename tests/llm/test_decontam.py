import random

import duckdb

from quillstack.llm import decontam

from .edge import docs, empty, text

BENCH = "item_id long, text string"


def brute(doc, items):
    hit = set()
    for i, item in items:
        w = min(13, len(item))
        allowed = 2 if w >= 13 else 1 if w >= 10 else 0
        for a in range(len(item) - w + 1):
            for b in range(len(doc) - w + 1):
                if sum(x == y for x, y in zip(item[a : a + w], doc[b : b + w])) >= w - allowed:
                    hit.add(i)
    return hit


def test_substitutions_against_brute_force(spark):
    r = random.Random(1)
    items = [(k, text(r, n)) for k, n in enumerate([40, 20, 13, 12, 11, 10, 9, 8, 5])]
    rows = []
    for k in range(120):
        item = items[k % len(items)][1].split()
        own = item[: r.randint(6, len(item))] if len(item) > 6 else item[:]
        for _ in range(r.randint(0, 4)):
            own[r.randrange(len(own))] = "swap"
        rows.append((k, f"{text(r, 10)} {' '.join(own).upper()}, {text(r, 5)}"))
    got = decontam.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, BENCH)).collect()
    want = {d: brute(t.lower().replace(",", "").split(), [(i, x.split()) for i, x in items]) for d, t in rows}
    assert {x["doc_id"]: x["n_items"] for x in got} == {d: len(w) for d, w in want.items()}
    assert {x["doc_id"]: x["item_id"] for x in got} == {d: min(w, default=None) for d, w in want.items()}
    assert 10 < sum(x["contaminated"] for x in got) < 110


def test_both_joins_agree(spark, monkeypatch):
    r = random.Random(5)
    items = [(k, text(r, n)) for k, n in enumerate([30, 14, 11, 9, 4, 1])]
    rows = [(k, f"{text(r, 20)} {' '.join(items[k % 6][1].split()[k % 3 :])} {text(r, 20)}") for k in range(60)]
    frames = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, BENCH)
    few = sorted(map(str, decontam.decontaminate(*frames).collect()))
    for name in ("SMALL_SEEDS", "SMALL_HITS", "SMALL_ITEMS"):
        monkeypatch.setattr(decontam, name, 0)
    assert sorted(map(str, decontam.decontaminate(*frames).collect())) == few
    assert all(set(decontam.COMMON) <= set(m) for m in decontam.MASKS)


def test_edges(spark):
    rows = docs(spark)
    base = rows.where("doc_id = 1").first()["text"]
    bench = spark.createDataFrame([(1, " ".join(base.split()[30:50])), (1, "other version of the same item with many words that nobody has"), (2, None), (None, base), (3, "")], BENCH)
    got = decontam.decontaminate(rows, bench)
    assert got.count() == rows.count()
    assert sorted((r["doc_id"] or 0) for r in got.where("contaminated").collect()) == [0, 1, 2, 3, 9]
    assert decontam.decontaminate(rows, spark.createDataFrame([], BENCH)).where("contaminated").count() == 0
    assert decontam.decontaminate(empty(spark), bench).count() == 0


def test_native_plan_and_sql(spark):
    d = "/root/testdata/sf0.001"
    got = decontam.decontaminate(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet"))
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    names = ["doc_id", *decontam.NAMES]
    want = c.execute(f"select {', '.join(names)} from ({decontam.ORACLE})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(names).collect())
