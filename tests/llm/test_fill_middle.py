import hashlib
import random
import re

import pytest

from quillstack.llm import fill_middle as f
from quillstack.llm import queries

from . import edge

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(key, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = sha(f"42:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 80 else "psm", len(p), len(m), out


def cases():
    r = random.Random(8)
    pool = ["a", "é", "𝄞", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", " ", " ", "<", "P>", "<P", "S", ">", "M>", "word"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " ", "\n\n", "x", " x ", "<P>", "a <M> b", "<<S>", "é" * 70, "w " * 5000, "nospace" * 3000, " " * 4000, "ab  " * 999 + "é"]
    return list(enumerate(texts)) + [(None, "no id here at all"), (5, "twice the same"), (5, "twice the same")]


@pytest.mark.parametrize("frame", [1 << 16, 100, 7])
def test_by_brute_force(spark, monkeypatch, frame):
    monkeypatch.setattr(f, "FRAME", frame)
    rows = cases()
    spark_rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "at int, doc_id long, text string")
    made = f.fill_middle(f.store(spark_rows))
    whole = {r["at"]: r for r in f.texts(made).collect()}
    done = {r["at"]: r for r in f.digests(made).collect()}
    forms = set()
    for i, (key, text) in enumerate(rows):
        n, form, prefix, middle, output = brute(key, text)
        r = done[i]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, prefix, middle), (i, text)
        assert whole[i]["output"] == output and r["output_sha256"] == sha(output) and r["restored_sha256"] == sha(text or "")
        assert whole[i]["n_chars"] == len(text or "") and whole[i]["output_bytes"] == len(output.encode())
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_only_cut_frames_are_opened(monkeypatch):
    monkeypatch.setattr(f, "FRAME", 1000)
    press = f.zstandard.ZstdCompressor()
    text = b"word number " * 5000
    frames, n, chars = f.frames_of(text, press)
    assert len(frames) == 60 and n == 10_001 and chars == len(text)
    seen, before = [], f.opened
    monkeypatch.setattr(f, "opened", lambda x: seen.append(x["bytes"]) or before(x))
    (_, lo), (_, hi) = (f.cut_at(frames, k, n, (chars, len(text))) for k in (100, 9000))
    assert len(seen) == 2
    w = f.Writer()
    w.copy(frames, lo, hi, len(text))
    w.flush()
    assert len(seen) == 4  # the frames between are taken as they are
    assert b"".join(f.read(w.frames, 0, w.size)) == text[lo:hi]
    assert f.marks_at(w.frames, w.size, [b"word"]) == [1]


def test_edge_rows_and_columns(spark):
    docs = edge.docs(spark).withColumnsRenamed({"size": "Form", "kept": "output"})
    made = f.fill_middle(f.store(docs))
    assert "Form" not in made.columns and "contaminated" in made.columns
    found = f.digests(made).collect()
    assert sorted((r["restored_sha256"] for r in found)) == sorted(sha(t or "") for _, t, *_ in edge.rows())
    assert f.digests(f.fill_middle(f.store(edge.empty(spark)))).count() == 0


def test_query_has_all_documents(spark):
    got = queries.QUERIES["op13_fill_in_middle"](spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(docs)
    for r in got:
        n, form, prefix, middle, output = brute(r["doc_id"], docs[r["doc_id"]])
        assert tuple(r) == (r["doc_id"], n, form, prefix, middle, sha(output), sha(docs[r["doc_id"]] or ""))
