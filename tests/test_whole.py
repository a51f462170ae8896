"""Catalog queries over all rows of small tables, held against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillstack.operators import search
from quillstack.plans import catalog

TEXTS = ["plain words one", "der und die", "les que", "same text", "same text", "same text", "Licensed under x", "tail"]
TURNS = [["x", "so on: when"], ["a" * 60, "b" * 60], ["x", "y", "z"], ["c" * 101], ["first", None, "third"]]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    n, r = 24, np.random.default_rng(5)
    texts = [TEXTS[i % len(TEXTS)] + ("" if i % 8 in (3, 4) else f" {i}") for i in range(n)]
    out = {
        "documents": pd.DataFrame({"doc_id": range(n), "text": texts, "lang": ["en", "de", "fr"] * (n // 3), "source": [f"src{i % 4}" for i in range(n)], "n_chars": [len(t) for t in texts]}),
        "events": pd.DataFrame({"event_id": range(6 * n), "ts": (pd.Timestamp("2024-01-01") + pd.to_timedelta(range(6 * n), "min")).astype("datetime64[us]"), "user_id": [i % n for i in range(6 * n)], "event_type": [("click", "view", "error")[i % n % 3 if i < 3 * n else i % 2] for i in range(6 * n)]}),
        "conversations": pd.DataFrame([(c, t, "user", TURNS[c % 5][t]) for t in (2, 0, 1) for c in range(0, n, 2) if t < len(TURNS[c % 5])], columns=["conv_id", "turn", "role", "text"]),
        "labels": pd.DataFrame({"doc_id": range(n), "quality": [i // 2 % 2 for i in range(n)], "toxic": [i % 3 // 2 for i in range(n)]}),
        "embeddings": pd.DataFrame({"vec_id": range(n), "embedding": [v.astype(np.float32) for v in r.normal(size=(n, 64))[[i if i != 11 else 1 for i in range(n)]]], "label": [i % 7 for i in range(n)]}),
        "orders": pd.DataFrame({"o_orderkey": range(1, n + 1), "o_orderpriority": ["1-URGENT" if i % 2 else "5-LOW" for i in range(1, n + 1)]}),
        "customer": pd.DataFrame({"c_custkey": [1, 2], "c_mktsegment": ["urgent goods", "other"]}),
    }
    d = tmp_path_factory.mktemp("whole")
    for name, df in out.items():
        df.to_parquet(d / f"{name}.parquet", index=False)
    return str(d), out


def run(spark, tables, name):
    return entry.queries()[name](spark, tables[0]).collect()


def test_all_orders_are_searched(spark, tables):
    got = {(r["source_table"], r["id"]) for r in run(spark, tables, "manifest_search")}
    assert got == {("customer", 1)} | {("orders", i) for i in range(1, 25, 2)}


def test_all_verdicts_count(spark, tables):
    labels = tables[1]["labels"]
    got = {r["tag"]: (r["n_pos"], r["n_neg"]) for r in run(spark, tables, "centroid_status")}
    assert got == {"good": (int(labels.quality.sum()), int((1 - labels.quality).sum())), "hd": (int((1 - labels.toxic).sum()), int(labels.toxic.sum()))}
    good = {r["item_id"] for r in run(spark, tables, "feedback_overlay") if r["tag"] == "good"}
    assert good == set(labels[labels.quality == 1].doc_id)


def test_centroids_of_all_labelled_vectors(spark, tables):
    e = tables[1]["embeddings"]
    live = np.array(["Licensed under" not in t for t in tables[1]["documents"].text])
    x, low = np.stack(e.embedding).astype(float)[live], (e.label < 3).to_numpy()[live]
    p, q = x[low].mean(0), x[~low].mean(0)
    p, q = p / np.linalg.norm(p), q / np.linalg.norm(q)
    got = {r["dim"]: (r["positive"], r["negative"]) for r in run(spark, tables, "train_centroids")}
    assert sorted(got) == list(range(1, 65)) and np.allclose([got[i + 1] for i in range(64)], np.stack([p, q], 1), atol=1e-5)
    score = 1 / (1 + np.exp(-8 * (x @ p - x @ q)))
    found = {r["item_id"]: r["confidence"] for r in run(spark, tables, "apply_centroids")}
    score = dict(zip(np.flatnonzero(live).tolist(), score.tolist()))
    assert set(found) == {i for i, v in score.items() if v >= 0.62} and all(abs(found[i] - score[i]) < 1e-4 for i in found)


def test_similarity_by_whole_contents(spark, tables):
    docs, e, events = (tables[1][t] for t in ("documents", "embeddings", "events"))
    live = [i for i, t in enumerate(docs.text) if "Licensed under" not in t]
    paths = {r["item_id"]: r["path"] for r in catalog.live_items(spark, tables[0]).collect()}

    def dhash(v):
        grid = [e.embedding[v][j % 64] for j in range(72)]
        bits = [grid[j // 8 * 9 + j % 8] > grid[j // 8 * 9 + j % 8 + 1] for j in range(64)]
        return f"{sum(int(b) << 63 - j for j, b in enumerate(bits)):016x}"

    sign = {("exact", i): f"{docs.n_chars[i]}:{hashlib.sha256(docs.text[i].encode()).hexdigest()}" for i in live}
    for i in live:
        if i % 5 in (1, 3):
            sign["image_phash", i] = dhash(i)
        if i % 5 in (0, 2):
            own = events[events.user_id == i].sort_values(["ts", "event_id"])
            starts = sorted((k * 5.0 if event % 9 else k * 7.0, k, kind) for k, (event, kind) in enumerate(zip(own.event_id, own.event_type)) if kind != "click")
            if starts:
                sign["video_fingerprint", i] = "|".join(dhash(len(kind)) for _, _, kind in starts[:3])
    groups = {}
    for (kind, i), s in sign.items():
        groups.setdefault((kind, s), []).append(i)
    groups = {k: sorted(v, key=lambda i: (-docs.n_chars[i], paths[i], i)) for k, v in groups.items() if len(v) > 1}
    want = {(*k, i, len(v), "candidate" if n else "keep") for k, v in groups.items() for n, i in enumerate(v)}
    assert {k for k, _ in groups} == {"exact", "image_phash", "video_fingerprint"}
    assert {tuple(r) for r in run(spark, tables, "similarity_index")} == want
    top = sorted(groups, key=lambda k: (-len(groups[k]), *k))[:10]
    assert {tuple(r) for r in run(spark, tables, "similarity_listing")} == {(s, i, n + 1) for kind, s in top for n, i in enumerate(groups[kind, s])}


def test_transcripts_hold_all_turns(spark, tables):
    docs = tables[1]["documents"]
    live = [i for i, t in enumerate(docs.text) if "Licensed under" not in t]
    said = {c: "\n".join(t for t in TURNS[c % 5] if t) for c in range(0, 24, 2)}
    assert {r["item_id"]: r["text"] for r in catalog.transcripts(spark, tables[0]).collect()} == said
    assert {r["item_id"] for r in run(spark, tables, "needs_timed_rerun")} == {i for i in live if len(said.get(i, "")) <= 100}
    names = {r["item_id"]: r["filename"] for r in catalog.live_items(spark, tables[0]).collect()}
    tags = {r["item_id"]: r["tags"] for r in run(spark, tables, "tags_concat")}
    digest = {i: hashlib.sha256(" ".join(x for x in (names[i], said.get(i), tags.get(i)) if x).encode()).hexdigest() for i in live}
    assert {r["item_id"]: r["digest"] for r in run(spark, tables, "semantic_texts")} == digest


def test_a_later_turn_is_searched(spark, tables, tmp_path):
    docs = pd.DataFrame({"doc_id": [0, 5, 10], "text": ["t" * 200] * 3, "lang": ["fr"] * 3, "source": ["s"] * 3, "n_chars": [200] * 3})
    docs.to_parquet(tmp_path / "documents.parquet", index=False)
    turns = [(0, 0, "user", "no"), (0, 1, "user", "then"), (10, 0, "user", "no")]
    pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet", index=False)
    items = catalog.live_items(spark, str(tmp_path))
    tags = spark.createDataFrame([(i, "hd", "confirmed") for i in (0, 5, 10)], "item_id long, tag string, state string")
    found = search.catalog_query(items, tags, catalog.transcripts(spark, str(tmp_path)), text="EN")
    assert [r["item_id"] for r in found.collect()] == [0]
