import collections
import re

import pytest

from quillstack.llm import components as components_module
from quillstack.llm import ngram_join
from quillstack.llm.components import components

from .edge import docs, empty

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = {}
    for i, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOW))
        sets.setdefault(i, []).append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    boss = {i: i for i in ids}

    def top(i):
        while boss[i] != i:
            i = boss[i]
        return i

    index = collections.defaultdict(set)
    for i in sorted(ids):
        near = {j for s in sets[i] for x in s for j in index[x]}
        for j in near:
            if any(100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = top(i), top(j)
                boss[max(a, b)] = min(a, b)
        for s in sets[i]:
            for x in s:
                index[x].add(i)
    return {i: top(i) for i in ids}, sets


def test_edges(spark):
    rows = docs(spark)
    want, sets = brute([(r["doc_id"], r["text"]) for r in rows.collect()])
    got = ngram_join.jaccard_components(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}
    assert ngram_join.jaccard_components(empty(spark)).count() == 0


def test_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want, _ = brute([tuple(r) for r in rows.collect()])
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(rows).collect()} == want


def test_chain_of_near_copies(spark):
    """Each differs a little from the one before; the ends share nothing."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 100])) for k in range(45)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and set(want.values()) == {0}


def test_large_group_of_near_copies(spark):
    words = [f"v{i}" for i in range(60)]
    rows = []
    for k in range(300):
        own = words.copy()
        own[k % 60] = f"x{k}"
        rows.append((k, " ".join(own)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 2), (2, 3), (5, 4), (6, 6), (None, 1)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}), ([(i, i + 1) for i in range(40)], dict.fromkeys(range(41), 0))])
def test_components(spark, edges, want):
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_components_in_rounds(spark, monkeypatch):
    """More edges than a task joins: forests first, then labels until none changes."""
    monkeypatch.setattr(components_module, "FOREST", 7)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100 + i % 5, 100 + i * 3 % 5) for i in range(12)] + [(60, 70), (70, 60), (None, 3), (9, 9)]
    boss = {x: x for e in edges if None not in e for x in e}
    for _ in boss:
        for a, b in edges:
            if a is not None:
                boss[a] = boss[b] = min(boss[a], boss[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == boss


def test_tiny_limits(spark, monkeypatch):
    """Every list is long, cut into sublists and shares, and no table is small enough for a broadcast."""
    for name, value in {"SUBLIST": 3, "LONG": 4, "SHARE": 2, "SMALL_IDS": 0, "SMALL_PAIRS": 0, "BLOCK": 2}.items():
        monkeypatch.setattr(ngram_join, name, value)
    words = [f"u{i}" for i in range(50)]
    rows = []
    for k in range(40):  # near copies, copies that differ too much, and chains of them
        own = words.copy()
        for j in range(k % 4):
            own[(k * 7 + j * 13) % 50] = f"x{k}y{j}"
        rows.append((k, " ".join(own[k % 3 :])))
    rows += [(40, rows[0][1]), (41, rows[0][1].upper()), (42, ""), (43, None), (44, "u1 u2")]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want, _ = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < 45
