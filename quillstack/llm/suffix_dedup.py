"""Removal of byte strings that an earlier document holds, by suffix arrays over the places that may repeat.

A byte goes if some 50-byte window over it also starts in a document with a smaller doc_id, judged on the input.

1.  Each window belongs to the smallest hash of the 24-byte strings in it, its key. Runs of neighbouring windows with one
    key form a strip; a window that occurs twice has the same key both times.
2.  Keys of two or more documents are found by one shuffle of (key, document); strips with other keys can't repeat.
    Of a key's documents in one piece of text, only the first and the last id go to the place where the key is judged.
3.  Equal strips become one by their 128-bit digest. Where one key has different strips, these are laid end to end,
    sorted by a two-stage suffix array, and adjacent common prefixes of 50 bytes or more give the smallest document of
    each window.
4.  Spans are merged for each document and cut from its text.

Keys whose different strips have over WIDE bytes have each window joined by its bytes instead, in cuts of STEP windows,
so that no task holds an unbounded group.

Defined results: null text counts as empty; texts under 50 bytes stay whole; a null doc_id counts as larger than any
other; rows that share a doc_id don't clear each other, and equal rows get equal results; columns of the input pass
through unless they have the names of results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Save, room, save
from .suffix_array import equal_runs, two_stage
from .textbytes import Spans, pieces, utf8

MATCH = 50
ANCHOR = 24
CHUNK = 1 << 20  # bytes that one suffix array covers
WIDE = 2 << 20  # bytes of one key's strips that go to one suffix array
STEP = 4096
DIGEST = ["high", "low"]
LAST = (1 << 63) - 1


def strips(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, number of windows, key) of each strip; windows as places in data[offs[0]:]."""
    none = np.zeros(0, np.int64)
    body = data[offs[0] : offs[-1]]
    if len(body) < MATCH:
        return none, none, none, none.astype(np.uint64)
    edge = offs - offs[0]
    grams = Spans(body).windows(ANCHOR)
    count = len(body) - MATCH + 1
    low, width = grams, 1
    while width * 2 <= MATCH - ANCHOR + 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = MATCH - ANCHOR + 1 - width
    low = np.minimum(low[: len(low) - rest], low[rest:])[:count] if rest else low[:count]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:count]
    inside = np.arange(count) + MATCH <= edge[1:][doc]  # windows that end in their own document
    head = inside.copy()
    head[1:] &= (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(head)
    tail = inside.copy()
    tail[:-1] &= head[1:] | ~inside[1:]
    return doc[first], first, np.flatnonzero(tail) - first + 1, low[first]


def with_identity(docs: DataFrame) -> DataFrame:
    """(id, mark, text): mark tells texts under one id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("mark"), "text")


def keys_of(texts: DataFrame) -> DataFrame:
    """(key, id, mark, spread) for each key of each text.

    Where a piece of text has a key in more than two documents, those between its first and last id are known to share
    it: their spread isn't 0, which keeps them from meeting in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(2))
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in pieces(offs):
                doc, _, _, key = strips(data, offs[lo : hi + 1])
                row = np.argsort(ids[lo:hi], kind="stable")
                place = np.empty(hi - lo, np.int64)
                place[row] = np.arange(hi - lo)
                order = np.lexsort((place[doc], key))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                doc, key = doc[new] + lo, key[new]
                inner = np.zeros(len(key), bool)
                inner[1:-1] = (key[1:-1] == key[:-2]) & (key[1:-1] == key[2:])
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
                last = np.append(first[1:], len(key)) - 1
                inner &= np.repeat(ids[doc[first]] != ids[doc[last]], last - first + 1) if len(key) else inner
                spread = np.where(inner, 1 + (marks[doc] & 0xFFFF), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(marks[doc]), pa.array(spread)], ["key", "id", "mark", "spread"])

    return texts.mapInArrow(run, "key long, id long, mark long, spread int")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows whose key has two or more ids, or that are spread. A key's rows come in order of id; only those of the first id wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        open_key = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(4)]
            known = rows[3] > 0
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[known]) for x in rows[:3]], ["key", "id", "mark"])
            rows = [x[~known] for x in rows[:3]]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.append(x, y) for x, y in zip(held, rows)]
            key, id_ = rows[0], rows[1]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last = np.append(first[1:], len(key)) - 1
            many = id_[first] != id_[last]
            if open_key is not None and key[0] == open_key:
                many[0] = True
            good = np.repeat(many, last - first + 1)
            if many[-1]:
                held, open_key = None, key[-1]
            else:  # one row for each mark is enough
                tail = [x[first[-1] :] for x in rows]
                _, once = np.unique(tail[2], return_index=True)
                held, open_key = [x[once] for x in tail], None
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in rows], ["key", "id", "mark"])

    return keys.repartition("key", "spread").sortWithinPartitions("key", "id").mapInArrow(run, "key long, id long, mark long")


def digests(body: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two numbers for each span: the BLAKE2b digest of its bytes, of 128 bits."""
    raw = b"".join(hashlib.blake2b(body[b:e], digest_size=16).digest() for b, e in zip(start.tolist(), end.tolist()))
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def strip_places(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, mark, key, high, low, start, size) for each strip whose key is among its text's shared keys; high and low: the digest of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(2))
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = batch.column(3)
            flat, bounds = wanted.values.to_numpy().view(np.uint64), wanted.offsets.to_numpy()
            for lo, hi in pieces(offs):
                doc, first, windows, key = strips(data, offs[lo : hi + 1])
                keep = np.isin(key, flat[bounds[lo] : bounds[hi]])  # keys are the same for equal bytes, whatever the document
                doc, first, windows, key = doc[keep], first[keep], windows[keep], key[keep]
                size = windows + MATCH - 1
                digest = digests(data[offs[lo] : offs[hi]].tobytes(), first, first + size)
                start = first - (offs[lo:hi][doc] - offs[lo])
                arrays = [ids[doc + lo], marks[doc + lo], key.view(np.int64), digest[:, 0], digest[:, 1], start.astype(np.int64), size.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in arrays], ["id", "mark", "key", "high", "low", "start", "size"])

    lists = keys.groupBy("id", "mark").agg(F.collect_list("key").alias("keys"))
    both = texts.join(lists, ["id", "mark"]).select("id", "mark", "text", "keys")
    return both.mapInArrow(run, "id long, mark long, key long, high long, low long, start long, size long")


def strip_bytes(texts: DataFrame, places: DataFrame) -> DataFrame:
    """places (id, mark, key, high, low, cut, start, size) -> (key, high, low, cut, first_id, strip); cut: windows before the strip's part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            *names, start, size = (lists.values.field(i).to_numpy()[bounds[0] : bounds[-1]] for i in range(6))
            for lo in range(0, len(row), 20_000):
                part = slice(lo, lo + 20_000)
                begin, length = (offs[row[part]] + start[part]), size[part]
                edge = np.concatenate([[0], np.cumsum(length)])
                at = np.repeat(begin - edge[:-1], length) + np.arange(edge[-1])
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])
                yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in names), batch.column(0).take(pa.array(row[part])), raw.cast(pa.binary())], ["key", "high", "low", "cut", "first_id", "strip"])

    lists = places.groupBy("id", "mark").agg(F.collect_list(F.struct("key", "high", "low", "cut", "start", "size")).alias("places"))
    return texts.join(lists, ["id", "mark"]).select("id", "text", "places").mapInArrow(run, "key long, high long, low long, cut long, first_id long, strip binary")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """rows (key, high, low, first_id, strip), strips of a key together -> (high, low, begin, end): windows that a smaller id has."""

    def judge(high: list, low: list, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
        length = np.array([len(x) for x in texts])
        start = np.concatenate([[0], np.cumsum(length[:-1] + 1)])
        of = np.repeat(np.arange(len(texts)), length + 1)
        order = two_stage(data, MATCH)
        order = order[order + MATCH <= (start + length)[of[order]]]
        run = equal_runs(data, order, MATCH)
        owner = np.array(ids, np.int64)
        head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else run
        least = np.minimum.reduceat(owner[of[order]], head)[run] if len(run) else run
        hit = np.sort(order[least < owner[of[order]]])
        new = np.ones(len(hit), bool)
        new[1:] = hit[1:] != hit[:-1] + 1
        begin = hit[new]
        end = np.append(hit[np.flatnonzero(new)[1:] - 1], hit[-1:]) + MATCH
        strip = of[begin]
        pick = lambda x: pa.array(np.array(x, np.int64)[strip])
        return pa.RecordBatch.from_arrays([pick(high), pick(low), pa.array(begin - start[strip]), pa.array(end - start[strip])], ["high", "low", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], []]
        size, last = 0, None
        for batch in batches:
            for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "high", "low", "first_id", "strip"))):
                if size > CHUNK and key != last:
                    yield judge(*held)
                    held, size = [[], [], [], []], 0
                for x, y in zip(held, row):
                    x.append(y)
                size, last = size + len(row[-1]), key
        if size:
            yield judge(*held)

    return rows.mapInArrow(run, "high long, low long, begin long, end long")


def repeats(docs: DataFrame) -> DataFrame:
    """(id, mark, spans): the byte spans of each text that go, with overlaps; texts that stay whole don't appear."""
    texts = with_identity(docs).where(F.octet_length("text") >= MATCH)
    spark = docs.sparkSession
    with room(spark) as keep:  # each table goes as soon as no later step reads it
        with room(spark) as keep_keys:
            shared = keep_keys(shared_keys(keys_of(texts)), "keys")
            found = keep(strip_places(texts, shared), "strips")  # repeated rows have their strips twice, which does no harm
        with room(spark) as keep_owners:
            verdicts = keep(verdicts_of(texts, found, keep_owners), "verdicts")
        slim = found.select("id", "mark", *DIGEST, (F.shiftleft("start", 32) + F.col("size")).alias("place"))
        both = slim.join(verdicts, DIGEST).where("id > first_id or runs is not null")
        start, size = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
        spans = F.when(F.col("id") > F.col("first_id"), F.array(F.struct(start.alias("begin"), (start + size).alias("end")))).otherwise(F.transform("runs", lambda r: F.struct((start + r["begin"]).alias("begin"), (start + r["end"]).alias("end"))))
        return save(both.select("id", "mark", F.inline(spans)).groupBy("id", "mark").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")


def verdicts_of(texts: DataFrame, found: DataFrame, keep: Save) -> DataFrame:
    """(high, low, first_id, runs) for each distinct strip: its first document, and the windows that a smaller id has in another strip."""
    owners = keep(found.groupBy("key", *DIGEST).agg(F.min("id").alias("first_id"), F.max("size").alias("size")), "owners")
    contested = owners.groupBy("key").agg(F.count("*").alias("strips"), F.sum("size").alias("bytes"), F.min("first_id").alias("x"), F.max("first_id").alias("y"))
    contested = keep(contested.where("strips > 1 and x <> y").select("key", "bytes"), "contested")
    rivals = owners.join(contested, "key").select(*DIGEST, F.col("first_id").alias("id"), "bytes")
    first = found.join(rivals, [*DIGEST, "id"]).groupBy("key", *DIGEST, "id").agg(F.min(F.struct("mark", "start", "size")).alias("at"), F.first("bytes").alias("bytes"))
    first = keep(first.select("id", "at.*", "key", *DIGEST, F.lit(0).cast("long").alias("cut"), "bytes"), "rivals")
    whole = strip_bytes(texts, first.where(F.col("bytes") <= WIDE))
    judged = repeated_windows(whole.repartition("key").sortWithinPartitions("key"))
    wide = first.where(F.col("bytes") > WIDE)
    if not wide.isEmpty():
        cuts = wide.withColumn("cut", F.explode(F.expr(f"sequence(0L, size - {MATCH}L, {STEP}L)")))
        cuts = cuts.withColumn("start", F.expr("start + cut")).withColumn("size", F.expr(f"least(size - cut, {STEP + MATCH - 1}L)"))
        windows = strip_bytes(texts, cuts).select(*DIGEST, "first_id", F.expr(f"inline(transform(sequence(1, length(strip) - {MATCH - 1}), i -> struct(substring(strip, i, {MATCH}) as window, cut + i - 1 as begin)))"))
        least = windows.groupBy("window").agg(F.min("first_id").alias("least"))
        hits = windows.join(least, "window").where("least < first_id").withColumn("island", F.expr("begin - row_number() over (partition by high, low order by begin)"))
        judged = judged.union(hits.groupBy(*DIGEST, "island").agg(F.min("begin").alias("begin"), (F.max("begin") + MATCH).alias("end")).select(*DIGEST, "begin", "end"))
    runs = judged.groupBy(*DIGEST).agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    return owners.join(runs, DIGEST, "left").select(*DIGEST, "first_id", "runs")


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without overlaps; touching ones become one."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    return begin[new], np.append(end[np.flatnonzero(new)[1:] - 1], end[-1:])


def whole_characters(body: bytes, begin: int, end: int) -> tuple[int, int]:
    """The span cut down to whole UTF-8 characters."""
    while begin < end and (body[begin] & 0xC0) == 0x80:
        begin += 1
    while end > begin and end < len(body) and (body[end] & 0xC0) == 0x80:
        end -= 1
    return begin, end


NAMES = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def remove_repeats(docs: DataFrame, characters: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    characters: spans shrink to whole characters, and text itself becomes what remains, instead of kept (null stays null).
    """
    spans = repeats(docs)
    new = NAMES[:4] if characters else NAMES
    names = [c for c in docs.columns if c.lower() not in new]
    kinds = dict(zip(NAMES, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType())))
    fields = [docs.schema[c] for c in names] + [T.StructField(n, kinds[n]) for n in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            data, offs = utf8(texts)
            lists = batch.column("_spans")
            bounds = lists.offsets.to_numpy()
            begins, ends = lists.values.field(0).to_numpy(), lists.values.field(1).to_numpy()
            for lo, hi in pieces(offs, 4 * CHUNK):
                out: list[list] = [[], [], [], [], []]
                for i in range(lo, hi):
                    body = data[offs[i] : offs[i + 1]].tobytes()
                    begin, end = begins[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]]
                    kept, n_spans = body, 0
                    if len(begin):
                        pairs = list(zip(*(x.tolist() for x in merged(begin, end))))
                        if characters:
                            pairs = [p for b, e in pairs if (p := whole_characters(body, b, e)) and p[0] < p[1]]
                        at = [0, *(x for p in pairs for x in p), len(body)]
                        kept, n_spans = b"".join(body[x:y] for x, y in zip(at[::2], at[1::2])), len(pairs)
                    for x, y in zip(out, (len(body), len(body) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept)):
                        x.append(y)
                whole = texts.slice(lo, hi - lo)
                arrays = [pa.array(x, t) for x, t in zip(out[:4], (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                kept = pa.array(out[4], pa.binary())
                if not characters:
                    arrays.append(kept)
                else:
                    whole = pa.compute.if_else(whole.is_null(), whole, kept.cast(whole.type))
                columns = [whole if n == "text" else batch.column(n).slice(lo, hi - lo) for n in names]
                yield pa.RecordBatch.from_arrays(columns + arrays, [*names, *new])

    keyed = docs.select(*names, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_mark"))
    both = keyed.join(spans.toDF("_id", "_mark", "_spans"), ["_id", "_mark"], "left")
    both = both.withColumn("_spans", F.coalesce("_spans", F.expr("cast(array() as array<struct<begin: bigint, end: bigint>>)"))).drop("_id", "_mark")
    return both.mapInArrow(run, T.StructType(fields))
