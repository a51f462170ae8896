import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillstack.llm import decontam, langid, ngram_join

from .test_ngram_join import brute

DIR = "/root/testdata/sf0.001"


def test_stages_hold_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    before = docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            model = langid.fit(spark.read.parquet(f"{DIR}/documents.parquet"))
            pred = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(before, docs.schema), model).collect()}
            assert set(kept[name]) == {i for i, r in pred.items() if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
            assert len(kept[name]) >= 0.97 * len(before)
        if name == "ngram_jaccard_join":
            want, _ = brute(list(kept["language_id"].items()))
            assert set(kept[name]) == set(want.values())
        if name == "suffix_array_dedup":
            windows: dict[bytes, int] = {}
            for i in sorted(kept["ngram_jaccard_join"]):
                body = (kept["ngram_jaccard_join"][i] or "").encode()
                gone = set()
                for p in range(len(body) - 49):
                    if windows.setdefault(body[p : p + 50], i) < i:
                        gone.update(range(p, p + 50))
                rest = bytes(c for p, c in enumerate(body) if p not in gone)
                if i in kept[name]:
                    assert len(kept[name][i].encode()) - len(rest) in range(0, 12 * (1 + len(gone)))  # whole characters stay
                    assert bool(gone) == (kept[name][i] != kept["ngram_jaccard_join"][i]) or len(gone) < 60
                else:
                    assert not rest.decode(errors="ignore").strip()
        if name == "benchmark_decontamination":
            left = spark.createDataFrame(list(kept["suffix_array_dedup"].items()), "doc_id long, text string")
            clean = decontam.decontaminate(left, spark.read.parquet(f"{DIR}/benchmark.parquet")).where("not contaminated")
            assert set(kept[name]) == {r["doc_id"] for r in clean.collect()}
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert len(mixed) == len(kept["benchmark_decontamination"]) and all(r["taken"] <= 3 * r["size"] for r in mixed)
    assert ngram_join.WORDS == 5


def survivors(rows):
    """Of rows with one doc_id, that with the smallest hash of its text, nulls last."""
    best = {}
    for r in rows:
        key = r["text"] is None, hashlib.sha256((r["text"] or "").encode()).hexdigest()
        if r["doc_id"] is not None and (r["doc_id"] not in best or key < best[r["doc_id"]][0]):
            best[r["doc_id"]] = key, r["text"]
    return {i: t for i, (_, t) in best.items()}


def test_one_row_stays_of_a_repeated_id(spark):
    r = random.Random(1)
    text = lambda: " ".join(f"w{r.randrange(9999)}" for _ in range(20))
    rows = [(i % 7, None if i % 5 == 0 else text(), i, {"a": i}) for i in range(30)] + [(50, "same", 2, {}), (50, "same", 1, {}), (None, "x y", 0, {}), (None, "x y", 0, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int, more map<string, int>")
    for part in (docs, docs.repartition(3, "extra")):
        got = corpus_pipeline.near_duplicates(spark, part, DIR)
        assert got.columns == docs.columns
        found = got.collect()
        assert {r["doc_id"]: r["text"] for r in found if r["doc_id"] is not None} == survivors(docs.collect())
        assert len(found) == 8 + 2 and [r["extra"] for r in found if r["doc_id"] == 50] == [1]


def test_run_keeps_clashing_columns(spark, tmp_path):
    from .edge import docs, empty

    own = ["n_tokens", "n_bytes", "lang_pred", "taken", "text_2"]
    rows = docs(spark).select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in own))
    for n, table in enumerate((rows, rows.limit(0), rows.select("doc_id", "text", "source", "lang"), empty(spark))):
        folder = tmp_path / str(n)
        table.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder))
        found = got.collect()
        assert bool(found) == (n in (0, 2))
        new = ["size", "source_size", "target", "taken"]
        assert got.columns == [c for c in table.columns if c not in new] + new
        for r in found if n == 0 else ():
            assert [r[c] for c in ("n_tokens", "n_bytes", "lang_pred", "text_2")] == [None if r["doc_id"] is None else f"{c}{r['doc_id']}" for c in ("n_tokens", "n_bytes", "lang_pred", "text_2")]
            assert (r["score"], r["kept"], r["id"], r["mark"], r["code"], r["contaminated"]) == ("a", "c", 1, 2, "d", "e") and r["n_chars"] == len(r["text"])
    first = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path / "0")).collect()}
    assert not {2, 3, 9} & first and {1, 7, 15} <= first  # copies and a near copy of 1; clean ones stay
