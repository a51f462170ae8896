import zlib

import numpy as np
import pandas as pd
import pytest

from quillstack.llm import quality, queries, toxicity

from .edge import docs, empty

LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    r = score.rank()
    n, m = (y == 1).sum(), (y == 0).sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * m)


@pytest.mark.parametrize("query,label,mod,held,least", [("op4_quality_classifier", "quality", 4, 2, 0.95), ("op5_toxicity", "toxic", 3, 1, 0.9)])
def test_held_out_ranking(spark, query, label, mod, held, least):
    d = "/root/testdata/sf0.1"
    found = queries.QUERIES[query](spark, d).toPandas()
    assert len(found) == 10_000 and found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % mod == held)).all()
    assert (found.predicted == (found.score >= 0.7)).all()
    both = found[found.held_out].merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    assert auc(both.score, both[label]) > least
    caught, wrong = both[both[label] == 1].predicted.mean(), both[both[label] == 0].predicted.mean()
    assert caught > 0.8 and wrong < 0.08  # at 0.7


@pytest.mark.parametrize("score,label", [(quality.score, "quality"), (toxicity.score, "toxic")])
def test_edges(spark, score, label):
    rows = docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, 0, 1), (7, None, None), (9, 0, 0), (11, 1, 0), (99, 1, 1), (None, 1, 1), (15, 0, 0)], LABELS)
    everything = quality.learnable(1_000_003, -1)
    got = score(rows, labels, everything).collect()
    assert len(got) == rows.count() and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["text"] and r["text"].startswith("twice")]
    assert len(same) == 2 and same[0] == same[1]
    none = labels.limit(0)
    assert score(rows, none, everything).count() == rows.count()
    assert score(empty(spark), labels, everything).count() == 0


def test_labels_are_no_input(spark):
    """Held-out labels change nothing."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    may = quality.learnable(4, 2)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = (dict(quality.score(rows, x, may).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a == b


def test_unlabelled_risk_by_brute_force(spark):
    """Loss and gradient over all unlabelled rows, summed in tasks, against a dense matrix."""
    rng = np.random.default_rng(5)
    x = rng.random((40, 6)) < 0.3
    n, w = rng.integers(1, 9, 40), rng.normal(size=7)
    rows = spark.createDataFrame([([int(j) for j in np.flatnonzero(r)], int(k)) for r, k in zip(x, n)], "x array<int>, n long").repartition(3)
    s = toxicity.sigmoid(x @ w[:-1] + w[-1])
    slope = n * s * (1 - s)
    assert np.allclose(toxicity.over_all(rows, w), [*(slope @ x), slope.sum(), (n * s).sum()])
    assert np.allclose(toxicity.over_all(rows.limit(0), w), 0)
