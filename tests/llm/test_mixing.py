import re
from collections import defaultdict

import numpy as np
import pytest

from quillstack.llm import mixing

from .edge import docs, empty


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    got = mixing.targets([1000, 10, 10], [1, 2, 3])
    assert got[1:] == [30, 30] and got[0] == 960
    assert mixing.targets([0, 5], [1, 2]) == [0, 5] and mixing.targets([], []) == []


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutations(n):
    for key in (1, 999):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def check(rows, near):
    got = mixing.mix_sources(rows).collect()
    assert len(got) == rows.count()
    by = defaultdict(lambda: [0, 0.0, 0, 0])
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        x = by[r["source"]]
        x[0] += r["size"]
        x[1], x[2] = r["target"], x[2] + r["taken"]
        assert r["source_size"] >= r["size"]
    total = sum(x[0] for x in by.values())
    assert abs(sum(x[1] for x in by.values()) - total) < 1e-3
    for size, target, taken, _ in by.values():
        assert target <= 3 * size + 1e-6 and abs(taken - target) <= near * target + 2 * mixing.BLOCK_WORDS
    key = lambda r: str((r["doc_id"], r["source"], r["text"], r["taken"]))
    again = mixing.mix_sources(rows.repartition(3)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 0.05)


def test_starts_in_two_levels(spark, monkeypatch):
    """Sums of groups of chunks and within them are the running sums over all chunks of a source."""
    monkeypatch.setattr(mixing, "GROUP", 4)
    rows = [(s, c, (c * 7919) % 13) for s in ("a", "b", None) for c in range(23) if (c + len(s or "")) % 5]
    got = {(r["source"], r["chunk"]): r["start"] for r in mixing.starts(spark.createDataFrame(rows, "source string, chunk long, words long")).collect()}
    assert got == {(s, c): sum(w for t, d, w in rows if t == s and d < c) for s, c, _ in rows}


def test_chunks_grow_with_the_rows(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    monkeypatch.setattr(mixing, "CHUNKS", 3)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 20)
    monkeypatch.setattr(mixing, "GROUP", 2)
    check(rows, 0.05)


def drawn(sizes, seed):
    """The draws of each source, as the method has them: a multinomial for each shard."""
    goals = mixing.targets(sizes, [1 + i % 3 for i in range(len(sizes))])
    slots = np.array([round(g) for g in goals])
    shards = -(-slots.sum() // mixing.SHARD_SLOTS)
    each = -(-slots.sum() // shards)
    draws = [np.random.Generator(np.random.Philox([seed, s])).multinomial(min(each, slots.sum() - s * each), slots / slots.sum()) for s in range(shards)]
    return np.array(draws), slots


@pytest.mark.parametrize("seed", [17, 18])
def test_draws_decide_what_is_taken(spark, seed):
    """Blocks of one word: a source's words in a shard are its draw there, and its words in all the sum of its draws."""
    rows = spark.range(300).selectExpr("id as doc_id", "repeat('w ', 190 + id % 21) as text", "concat('s', id % 3) as source")
    got = mixing.mix_sources(rows, block_words=1, seed=seed).select("doc_id", "source", "size", "taken").collect()
    sizes = [sum(r["size"] for r in got if r["source"] == f"s{i}") for i in range(3)]
    draws, slots = drawn(sizes, seed)
    assert (abs(draws.sum(0) - slots) <= mixing.NEAR * slots).all() and (draws.sum(0) != slots).any()
    assert [sum(r["taken"] for r in got if r["source"] == f"s{i}") for i in range(3)] == draws.sum(0).tolist()
    spans = mixing.mix_spans(rows, block_words=1, seed=seed).collect()
    held = defaultdict(int)
    for r in spans:
        held[r["shard"], int(r["source"][1:])] += r["words"]
    assert dict(held) == {(s, c): n for (s, c), n in np.ndenumerate(draws) if n}


def test_spans_are_what_is_taken(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    size = {r["doc_id"]: r for r in mixing.mix_sources(rows).select("doc_id", "size", "taken").collect()}
    taken, slots = defaultdict(int), defaultdict(set)
    for r in mixing.mix_spans(rows).collect():
        assert r["first_word"] >= 0 < r["words"] and r["first_word"] + r["words"] <= size[r["doc_id"]]["size"]
        taken[r["doc_id"]] += r["words"]
        slots[r["source"], r["slot"]].add(r["shard"])
    assert dict(taken) == {i: r["taken"] for i, r in size.items() if r["taken"]}
    assert all(len(s) == 1 for s in slots.values())


def test_edges(spark):
    check(docs(spark), 0.2)
    assert mixing.mix_sources(empty(spark)).count() == 0
    assert {"code", "id", "mark", "score"} <= set(mixing.mix_sources(docs(spark)).columns)
