import hashlib
import zlib

import pytest

from quillstack.llm import media
from quillstack.llm.suffix_dedup import with_identity

from .edge import docs, empty


def test_edges_round_trip(spark):
    rows = docs(spark)
    got = sorted(str((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"])) for r in media.media_report(rows).collect())
    want = []
    for r in rows.collect():
        b = (r["text"] or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        m = media.wav(p)
        want.append(str((r["doc_id"], len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest())))
    assert got == sorted(want)
    assert media.media_report(empty(spark)).count() == 0


def test_chunks_survive_an_insertion():
    import numpy as np

    x = np.random.default_rng(0).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    y = x[:100] + b"new" + x[100:]

    def chunks(b):
        ends = (np.flatnonzero(media.gear(np.frombuffer(b, np.uint8)) >> np.uint32(32 - media.CUT_BITS) == 0) + 1).tolist()
        at = [0, *media.cuts(ends, 0, len(b))]
        assert b"".join(b[i:j] for i, j in zip(at, at[1:])) == b and all(j - i <= media.MOST for i, j in zip(at, at[1:]))
        return {b[i:j] for i, j in zip(at, at[1:])}

    a, b = chunks(x), chunks(y)
    assert len(a & b) > 0.9 * len(a)


def test_chunks_are_stored_once_and_verified(spark):
    texts = with_identity(docs(spark)).dropDuplicates(["id", "mark"])
    packs = media.store(texts).collect()
    kept = [e["digest"] for p in packs for e in p["entries"] if e["kept"]]
    assert len(kept) == len({bytes(d) for d in kept}) == len({bytes(e["digest"]) for p in packs for e in p["entries"]})
    broken = spark.createDataFrame([(p["id"], p["mark"], p["n_bytes"], p["media_sha256"], p["header"], p["entries"], bytes(len(p["pack"]))) for p in packs], media.store(texts.limit(0)).schema)
    with pytest.raises(Exception, match="differs"):
        media.read_back(broken).collect()
