import math

import numpy as np
import pytest

from quillstack.llm import hard_negatives as h
from quillstack.llm import queries

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, is_anchor, k=5, m=10, low=30, high=90):
    good = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows if None not in (i, y, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in good if is_anchor(i)}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in good if len(w) == len(v))
        alike = [(-s, j) for s, j, z in scores if z == y and j != i][:k]
        for p, j in alike:
            own = [(-s, n) for s, n, z in scores if z != y and low * p <= -100 * s <= high * p][:m]
            out += [(i, j, rank, n, p, s) for rank, (s, n) in enumerate(own, 1)]
    return sorted(out)


def cases(n=150, dim=6):
    r = np.random.default_rng(1)
    rows = [(i * 3 % 400, int(r.integers(0, 3)), np.float32(r.integers(-3, 4, dim) / 4).tolist()) for i in range(n)]
    rows += [(1000 + i, i % 3, rows[0][2]) for i in range(40)]  # many ties
    rows += [(500, 1, None), (600, None, [1.0] * dim), (None, 1, [1.0] * dim), (700, 1, [None] * dim), (800, 1, [float("nan")] * dim), (900, 1, [float("inf")] * dim)]
    rows += [(50, 1, [1.0, 2.0]), (53, 1, [1.0, 1.0]), (54, 2, [1.0, 0.25]), (1100, 1, []), (1101, 1, []), (0, rows[0][1], rows[0][2]), (2000, 0, [0.0] * dim), (2001, 0, [300.5] * dim)]
    return rows


@pytest.mark.parametrize(("anchors", "batch"), [(4096, 10_000), (3, 7)])
def test_by_brute_force(spark, monkeypatch, anchors, batch):
    monkeypatch.setattr(h, "ANCHORS", anchors)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = cases()
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", extra string, rank int").repartition(3)
        got = h.hard_negatives(df, df["vec_id"] % 50 == 0)
        assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("size", [1, 10, 200, 1 << 16, 1 << 24])
def test_exact_products(size):
    r = np.random.default_rng(2)
    a, b = r.integers(-size, size + 1, (5, 700)), r.integers(-size, size + 1, (4, 700))
    a[0], b[0], b[1] = size, size, -size
    assert np.array_equal(h.exact_products(a, b), a @ b.T)


def test_past_64_bits():
    with pytest.raises(ValueError, match="64 bits"):
        h.exact_products(np.full((1, 1), 1 << 40), np.full((1, 1), 1 << 40))


def test_largest_sums_of_residues_are_exact_in_float32():
    assert all((p // 2) ** 2 * h.PART < 1 << 24 for p in h.PRIMES)
    for p in h.PRIMES:
        x = np.full((1, 3 * h.PART + 1), p // 2)
        assert h.product_mod(x, x, p)[0, 0] == int((x[0] * x[0]).sum()) % p
        assert h.product_mod(x, -x, p)[0, 0] == -int((x[0] * x[0]).sum()) % p


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert h.hard_negatives(df, df["vec_id"] % 2 == 0).collect() == []
    alone = spark.createDataFrame([(0, 1, [1.0])], SCHEMA)
    assert h.hard_negatives(alone, alone["vec_id"] == 0).collect() == []


def test_query_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    rows = [(i, (y + 1) % 10 if i % 7 == 0 else y, v) for i, y, v in rows]
    got = queries.QUERIES["op11_hard_negatives"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got)) == brute(rows, lambda i: i % 100 == 0) and got
