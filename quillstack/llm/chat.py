"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is `<|role|>`, a line feed, the text and `<end>` with a line feed. Inside
roles and texts `\\`, `<`, `[` and `|` are escaped, so that no control string of this or another template can occur
there; unescaping gives the text back. The whole is encoded once. Markers are tokens of their own, so that no token has
a part in two texts. The offsets of tokens are the running sum of their lengths in bytes; the spans of learned texts,
which are in order, find their tokens by binary search, and the mask holds what they have in common.

Defined results: null texts and roles count as empty; turns are ordered by turn (null first), then role, then text;
repeated rows are turns of their own; rows with a null conv_id are one conversation; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "|": "\\p"}
TABLE = str.maketrans(ESCAPES)
PLAIN = {v[1]: k for k, v in ESCAPES.items()}
MARKERS = ("<|", "|>\n", "<end>\n")
TURN = re.compile(r"<\|([^<|]*)\|>\n([^<]*)<end>\n")
GROUP = 256


def escape(text: str) -> str:
    return text.translate(TABLE)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: PLAIN[m[1]], text)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the learned role's texts in its UTF-8 bytes."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{escape(role)}|>\n", escape(text)
        begin = at + len(head.encode())
        end = begin + len(body.encode())
        if role == learned:
            spans.append((begin, end))
        out += [head, body, MARKERS[2]]
        at = end + len(MARKERS[2])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@lru_cache(1)
def tokenizer(path: str):  # noqa: ANN201
    """The byte-level encoding of a file of ranks, with the markers as special tokens, and the length in bytes of each token."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    first = max(ranks.values()) + 1
    markers = {m: first + i for i, m in enumerate(MARKERS)}
    size = np.zeros(first + len(markers), np.int64)
    for word, rank in [*ranks.items(), *((m.encode(), i) for m, i in markers.items())]:
        size[rank] = len(word)
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=markers), size


def masked(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The tokens that have a part in the spans, and these parts by span. Tokens lie end to end; spans are in order and apart."""
    begin, end = (np.array([s[i] for s in spans if s[0] < s[1]], np.int64) for i in (0, 1))
    lo, hi = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left")
    met = lo < hi
    begin, end, lo, hi = begin[met], end[met], lo[met], hi[met]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi, -1)
    parts = zip(np.maximum(starts[lo], begin).tolist(), np.minimum(ends[hi - 1], end).tolist()) if len(lo) else ()
    return np.cumsum(edge[:-1]) > 0, list(parts)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def offsets(lists: list) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32))


def format_conversations(rows: DataFrame, path: str | None = None, learned: str = "assistant") -> DataFrame:
    """(conv_id, formatted, input_ids, loss_mask, loss_spans) for each conversation; loss_spans in bytes of formatted."""
    path = path or default_tokenizer()
    none = F.lit("")
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text")))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = tokenizer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP):
                part = batch.slice(lo, GROUP)
                held = part.column(1)
                flat = held.flatten()
                own = list(zip(flat.field("role").to_pylist(), flat.field("text").to_pylist()))
                cut = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
                rendered = [render(own[a:b], learned) for a, b in zip(cut[:-1], cut[1:])]
                ids, masks, spans = [], [], []
                for text, mine in rendered:
                    ids.append(np.array(encode.encode(text, allowed_special="all"), np.int32))
                    ends = np.cumsum(size[ids[-1]])
                    mask, parts = masked(mine, ends - size[ids[-1]], ends)
                    masks.append(mask)
                    spans.append(parts)
                kind = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
                places = np.array([x for s in spans for x in s], np.int64).reshape(-1, 2)
                lists = [
                    pa.ListArray.from_arrays(offsets(ids), pa.array(np.concatenate(ids))),
                    pa.ListArray.from_arrays(offsets(ids), pa.array(np.concatenate(masks))),
                    pa.ListArray.from_arrays(offsets(spans), pa.StructArray.from_arrays([pa.array(places[:, 0]), pa.array(places[:, 1])], fields=list(kind))),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rendered], pa.string()), *lists], ["conv_id", "formatted", "input_ids", "loss_mask", "loss_spans"])

    return turns.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, formatted string, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<begin: long, end: long>>")


def read_back(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of what a formatted conversation says, and of the text of the tokens under its mask."""
    path = path or default_tokenizer()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = tokenizer(path)
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            ids, mask = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
            cut = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
            for text, a, b in zip(batch.column(1).to_pylist(), cut[:-1], cut[1:]):
                turns = parse(text)
                under = ids[a:b][mask[a:b]]
                loss = unescape(encode.decode_bytes(under.tolist()).decode())
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                for x, y in zip(out, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), b - a, len(under))):
                    x.append(y)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], names)

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "input_ids", "loss_mask").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
