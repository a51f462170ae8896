import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import suffix_array, suffix_dedup

from .edge import docs, empty


def brute(rows):
    rows = [(suffix_dedup.LAST if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in rows:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.append([False], gone).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    got = suffix_dedup.remove_repeats(df).collect()
    return sorted((suffix_dedup.LAST if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)


@settings(deadline=None, max_examples=60)
@given(st.binary(max_size=120), st.integers(1, 4))
def test_two_stage_sorts_suffixes(data, letters):
    x = (np.frombuffer(data, np.uint8) % letters + 97).astype(np.uint8)
    body = x.tobytes()
    assert [body[i:] for i in suffix_array.two_stage(x, 128)] == sorted(body[i:] for i in range(len(body)))


def test_edges(spark):
    rows = docs(spark)
    assert found(rows) == brute([(r["doc_id"], r["text"]) for r in rows.collect()])
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    assert {"score", "id", "mark", "kept"} <= set(suffix_dedup.remove_repeats(rows).columns)


@pytest.mark.parametrize("wide, step", [(2 << 20, 4096), (1, 4096), (1, 3)])
def test_against_brute_force(spark, monkeypatch, wide, step):
    """wide = 1 sends all keys with rivals the other way."""
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(rows) == brute([tuple(r) for r in rows.collect()])


def test_overlapping_and_periodic_repeats(spark):
    rows = [(1, "ab" * 60), (2, "ab" * 40 + "c" * 70), (3, "x" * 30 + "ab" * 30 + "c" * 60), (4, "c" * 55), (5, "c" * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


@pytest.mark.parametrize("wide", [2 << 20, 1000])
def test_long_periodic_strips(spark, monkeypatch, wide):
    """Strips of tens of thousands of windows, which a bound on their number wouldn't see."""
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "STEP", 500)
    cells = "abcdefgh" * 6000
    rows = [(1, cells), (2, cells[3:30000] + "Z" + cells[30001:]), (3, "q" * 20000 + cells[:9000]), (4, "q" * 30000), (5, cells), (5, cells + "q" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


def test_many_documents_of_one_key(spark):
    """All but the first and the last document of a piece pass without being judged, in any order and with ids that repeat."""
    passage = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(90))
    rows = [((i * 37) % 101 + (1 if i < 50 else 0), f"{i} own words {i * i} of the text {passage} and {i * 7919} more") for i in range(120)]
    rows += [(None, passage), (7, None), (8, ""), (9, passage[:49])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
    texts = suffix_dedup.with_identity(df.coalesce(1)).where("octet_length(text) >= 50")
    keys = suffix_dedup.keys_of(texts)
    assert keys.where("spread > 0").count() > 0
    judged = keys.where("spread = 0").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert judged == 2
    one = spark.createDataFrame([(3, passage), (3, passage + "x"), (3, "y" + passage)], "doc_id long, text string")
    assert found(one) == brute([tuple(r) for r in one.collect()])


def test_strips_are_told_apart_by_their_bytes():
    """Texts whose sums modulo 2**64 may agree whatever the base: the Thue-Morse word and its complement."""
    word = [bin(i).count("1") % 2 for i in range(2048)]
    body = "".join("ab"[x] for x in word + [1 - x for x in word]).encode()
    got = suffix_dedup.digests(body, np.array([0, 2048, 0]), np.array([2048, 4096, 2048]))
    assert got[0].tolist() != got[1].tolist() and got[0].tolist() == got[2].tolist()


def test_whole_characters(spark):
    rows = [(1, "a" + "é" * 60), (2, "b" + "é" * 60 + "z")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), characters=True)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: rows[0][1], 2: "bz"}
