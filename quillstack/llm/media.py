"""Media columns in a chunk store: content-defined chunks, stored once, and ordered lists that rebuild verified media.

A payload becomes 8-bit mono audio: a 44-byte RIFF header and one sample for each byte. A rolling gear hash over the last
32 bytes cuts the samples into chunks of 256 to 4,096 bytes (about 1 KB on average); the header stays with the list.
Chunks are joined by SHA-256 digest: the smallest (document, place) that has a chunk keeps its bytes, in the pack of its
document; all others refer to it. To rebuild a medium, its own pack is read, lent chunks are joined by digest, and every
chunk and the whole are held against their digests; a difference raises an error.

Defined results: null text counts as empty, with a payload of 64 zero bytes; a null doc_id is kept; repeated rows give
equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import save
from .suffix_dedup import LAST
from .textbytes import VALUES, pieces, utf8

UNIT = 64
RATE = 16_000
HEADER = 44
LEAST, MOST, CUT_BITS = 256, 4096, 10
GEAR = (VALUES >> np.uint64(31)).astype(np.uint32)
PACKED = 4 << 20
SMALL_IDS = 500_000  # rows of (id, mark) up to which they are broadcast (20 MB)


def payload_of(text: bytes) -> bytes:
    return text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def wav(payload: bytes) -> bytes:
    """Unsigned 8-bit mono samples with their header."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    """The samples of a stored medium, by its header."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a medium of this store")
    return media[HEADER : HEADER + struct.unpack("<I", media[40:44])[0]]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: the sum of the last 32 bytes' values, each shifted by its distance."""
    h = GEAR[data]
    step = 1
    while step < 32:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def cuts(ends: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of data[start:stop]; ends: places after which the hash says cut."""
    out, at = [], start
    while at < stop:
        i = bisect_left(ends, at + LEAST)
        to = ends[i] if i < len(ends) else stop
        at = min(to, at + MOST, stop)
        out.append(at)
    return out


def chunk_list(media: bytes, ends: list[int], base: int) -> list[tuple[bytes, int]]:
    """(samples, size) of each chunk; ends: the hash's cuts in a longer array in which the medium starts at base."""
    at, out = base + HEADER, []
    for to in cuts(ends, at, base + len(media)):
        out.append((media[at - base : to - base], to - at))
        at = to
    return out


def hash_cuts(media: list[bytes]) -> list[int]:
    flat = np.frombuffer(b"".join(media), np.uint8)
    return (np.flatnonzero(gear(flat) >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()


def chunked(docs: DataFrame) -> DataFrame:
    """(id, mark, n_bytes, media_sha256, chunks): the ordered chunk list of each text's medium."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(2))
            for lo, hi in pieces(offs):
                media = [wav(payload_of(data[offs[i] : offs[i + 1]].tobytes())) for i in range(lo, hi)]
                ends, base, lists = hash_cuts(media), 0, []
                for m in media:
                    lists.append([{"idx": i, "digest": hashlib.sha256(c).digest(), "size": n} for i, (c, n) in enumerate(chunk_list(m, ends, base))])
                    base += len(m)
                kind = pa.list_(pa.struct([("idx", pa.int32()), ("digest", pa.binary()), ("size", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(offs[lo : hi + 1])), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(lists, kind)],
                    ["id", "mark", "n_bytes", "media_sha256", "chunks"],
                )

    return docs.mapInArrow(run, "id long, mark long, n_bytes long, media_sha256 string, chunks array<struct<idx: int, digest: binary, size: int>>")


PACKS = "id long, mark long, n_bytes long, media_sha256 string, header binary, entries array<struct<idx: int, digest: binary, size: int, kept: boolean, lent: boolean>>, pack binary"


def store(docs: DataFrame) -> DataFrame:
    """docs (id, mark, text), each once -> packs (id, mark, n_bytes, media_sha256, header, entries, pack) that hold each distinct chunk once.

    Texts without a chunk in common with others are packed where they are read; only the others meet their lists.
    """
    manifest = save(chunked(docs), "manifest")
    entries = manifest.select("id", "mark", F.expr("inline(chunks)"))
    owners = entries.groupBy("digest").agg(F.min(F.struct("id", "mark", "idx")).alias("owner"), F.count("*").alias("uses")).where("uses > 1").select("digest", "owner")
    owners = save(owners, "owners")
    ids = save(entries.join(owners, "digest", "left_semi").select("id", "mark").distinct(), "sharers")
    near = F.broadcast(ids) if ids.count() <= SMALL_IDS else ids
    placed = entries.join(near, ["id", "mark"], "left_semi").join(owners, "digest", "left").select(
        "id", "mark", "idx", "digest", "size", F.coalesce(F.struct("id", "mark", "idx") == F.col("owner"), F.lit(True)).alias("kept"), F.col("owner").isNotNull().alias("lent")
    )
    lists = placed.groupBy("id", "mark").agg(F.sort_array(F.collect_list(F.struct("idx", "digest", "size", "kept", "lent"))).alias("entries"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            given = batch.column("entries") if "entries" in batch.schema.names else None
            for lo, hi in pieces(offs, PACKED):
                media = [wav(payload_of(data[offs[i] : offs[i + 1]].tobytes())) for i in range(lo, hi)]
                base, lists, packs = 0, [], []
                ends = hash_cuts(media) if given is None else []
                for i, m in enumerate(media):
                    if given is None:
                        own = [{"idx": j, "digest": hashlib.sha256(c).digest(), "size": n, "kept": True, "lent": False} for j, (c, n) in enumerate(chunk_list(m, ends, base))]
                        packs.append(m[HEADER:])
                    else:
                        own, at, parts = given[lo + i].as_py(), HEADER, []
                        for e in own:
                            if e["kept"]:
                                parts.append(m[at : at + e["size"]])
                            at += e["size"]
                        packs.append(b"".join(parts))
                    lists.append(own)
                    base += len(m)
                kind = pa.list_(pa.struct([("idx", pa.int32()), ("digest", pa.binary()), ("size", pa.int32()), ("kept", pa.bool_()), ("lent", pa.bool_())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), batch.column("mark").slice(lo, hi - lo), pa.array(np.diff(offs[lo : hi + 1])), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array([m[:HEADER] for m in media], pa.binary()), pa.array(lists, kind), pa.array(packs, pa.binary())],
                    ["id", "mark", "n_bytes", "media_sha256", "header", "entries", "pack"],
                )

    alone = docs.join(near, ["id", "mark"], "left_anti").select("id", "mark", "text").mapInArrow(pack, PACKS)
    sharing = docs.join(near, ["id", "mark"], "left_semi").join(lists, ["id", "mark"]).select("id", "mark", "text", "entries").mapInArrow(pack, PACKS)
    return save(alone.union(sharing), "packs")


def lent_chunks(packs: DataFrame) -> DataFrame:
    """(digest, body) of the stored chunks that other lists refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, bodies = [], []
            for entries, pack in zip(batch.column(0).to_pylist(), batch.column(1)):
                at, body = 0, pack.as_buffer()
                for e in entries:
                    if e["kept"]:
                        if e["lent"]:
                            digests.append(e["digest"])
                            bodies.append(body.slice(at, e["size"]).to_pybytes())
                        at += e["size"]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"])

    return packs.where("exists(entries, e -> e.kept and e.lent)").select("entries", "pack").mapInArrow(run, "digest binary, body binary")


def describe(media: bytes) -> str:
    """Features of the samples: mean, root mean square, peak and crossings of the middle."""
    x = np.frombuffer(samples(media), np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"mean={x.mean():.6f};rms={np.sqrt((x * x).mean()):.6f};peak={int(np.abs(x).max())};crossings={crossings}"


def read_back(packs: DataFrame) -> DataFrame:
    """(id, mark, ...digests and features) of each medium, rebuilt from packs and lent chunks."""
    borrowed = packs.where("exists(entries, e -> not e.kept)").select("id", "mark", F.expr("inline(filter(entries, e -> not e.kept))")).select("id", "mark", "idx", "digest")
    loans = borrowed.join(lent_chunks(packs), "digest").groupBy("id", "mark").agg(F.collect_list(F.struct("idx", "body")).alias("loans"))
    none = F.expr("cast(array() as array<struct<idx: int, body: binary>>)")
    alone = packs.where("not exists(entries, e -> not e.kept)").withColumn("loans", none)
    rest = packs.where("exists(entries, e -> not e.kept)").join(loans, ["id", "mark"], "left").withColumn("loans", F.coalesce("loans", none))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for sha, header, entries, pack, loans in zip(*(batch.column(c) for c in ("media_sha256", "header", "entries", "pack", "loans"))):
                sha, entries, pack = sha.as_py(), entries.as_py(), pack.as_py()
                lent, at, chunks = {x["idx"]: x["body"] for x in loans.as_py()}, 0, [header.as_py()]
                for e in entries:
                    if e["kept"]:
                        body = pack[at : at + e["size"]]
                        at += e["size"]
                    else:
                        body = lent[e["idx"]]
                    if hashlib.sha256(body).digest() != e["digest"]:
                        raise ValueError("a chunk differs from its digest")
                    chunks.append(body)
                media = b"".join(chunks)
                if hashlib.sha256(media).hexdigest() != sha:
                    raise ValueError("a medium differs from its digest")
                payload = samples(media)
                for x, y in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha, describe(media))):
                    x.append(y)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), batch.column("n_bytes")] + [pa.array(x, k) for x, k in zip(out, kinds)], ["id", "mark", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return alone.unionByName(rest.select(alone.columns)).mapInArrow(run, "id long, mark long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_report(docs: DataFrame) -> DataFrame:
    """Stores every text as a medium and reports what is read back, a row for each row of docs."""
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("mark"), "text")
    rows = save(keyed.select("doc_id", "id", "mark"), "rows")
    repeated = save(rows.groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "repeated")
    texts = keyed.select("id", "mark", "text")
    if not repeated.isEmpty():
        texts = texts.join(repeated, ["id", "mark"], "left_anti").unionByName(texts.join(repeated, ["id", "mark"], "left_semi").dropDuplicates(["id", "mark"]))
    found = read_back(store(texts))
    return rows.join(found, ["id", "mark"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
