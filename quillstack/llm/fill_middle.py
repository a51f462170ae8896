"""Fill-in-the-middle over texts that are stored as seekable compressed frames.

`store` cuts the UTF-8 bytes of a text into frames of FRAME bytes, each a zstandard frame of its own, and keeps with it
how many units, code points and bytes come before it. A unit is a run of white space with the word after it, or the white
space at the end. `fill_middle` draws two cuts by unit number from a hash of the id; the counts tell which frames hold
them, only those are decompressed, and the output is a list of frames again: markers and the parts of cut frames are
compressed anew, whole frames between are taken as they are. `digests` and `restored` stream the frames in order.

The stored table is written to the shared folder, so that a lost executor costs a task. Memory of a task doesn't grow with
the number of rows; of one text it holds the compressed frames and a few frames of bytes at once.

Defined results: a null text is empty, and an empty text is plain; a null id hashes as the empty string; texts with one
of the markers are plain, so that each output can be turned back; repeated rows give repeated rows; other columns stay in
`store` and `fill_middle`, those with the names of results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import save

FRAME = 1 << 16
LEVEL = 3
MARKS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix and the middle
STORED = ("n", "n_chars", "n_bytes", "marked", "frames")
MADE = ("form", "prefix_chars", "middle_chars", "output_bytes", "output")
FRAMES = T.ArrayType(T.StructType([T.StructField("units", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("in_word", T.BooleanType()), T.StructField("data", T.BinaryType())]))
OUTPUT = T.ArrayType(T.StructType([T.StructField("bytes", T.LongType()), T.StructField("data", T.BinaryType())]))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
Rows = dict[str, list]


def unit_starts(data: np.ndarray, in_word: bool) -> np.ndarray:
    """Where units start: at white space after a word. The first unit of a text starts without one; in_word: what comes before."""
    space = SPACE[data]
    return np.flatnonzero(space & np.concatenate([[in_word], ~space[:-1]]))


def frames_of(text: bytes, press: zstandard.ZstdCompressor) -> tuple[list[dict], int, int]:
    """(frames, units, code points). The cut after k units is where unit k starts, counted from 0; the first one at byte 0."""
    out, chars, in_word = [], 0, False
    units = 1 if text else 0
    for at in range(0, len(text), FRAME):
        part = text[at : at + FRAME]
        data = np.frombuffer(part, np.uint8)
        out.append({"units": units, "chars": chars, "bytes": at, "in_word": in_word, "data": press.compress(part)})
        units += len(unit_starts(data, in_word))
        chars += int(np.count_nonzero((data & 0xC0) != 0x80))
        in_word = not SPACE[data[-1]]
    return out, units, chars


def in_tasks(rows: DataFrame, fields: list[T.StructField], work: Callable[[Rows], Rows], needs: tuple[str, ...], drop: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the columns of `fields`, made by `work` from those in `needs`, a few rows at once; `drop` goes."""
    new = {f.name.lower() for f in fields}
    kept = [c for c in rows.columns if c.lower() not in new and c not in drop]
    source = rows.select(*kept, *(F.col(c).alias(f"_in_{i}") for i, c in enumerate(needs)))
    schema = T.StructType([*(source.schema[c] for c in kept), *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = work({c: part.column(len(kept) + i).to_pylist() for i, c in enumerate(needs)})
                types = types or [arrow(f.dataType) for f in fields]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *(pa.array(made[f.name], t) for f, t in zip(fields, types))], [*kept, *(f.name for f in fields)])

    return source.mapInArrow(run, schema)


def arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n (units), n_chars, n_bytes, marked and frames in place of the text, written to the shared folder."""
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(whole, F.lit(mark))
    rows = docs.withColumns({"_marked": marked, "_text": whole.cast("binary")})
    fields = [T.StructField("n", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("marked", T.BooleanType()), T.StructField("frames", FRAMES)]

    def work(columns: Rows) -> Rows:
        press = zstandard.ZstdCompressor(level=LEVEL)
        found = [frames_of(t, press) for t in columns["_text"]]
        return {"n": [u for _, u, _ in found], "n_chars": [c for _, _, c in found], "n_bytes": [len(t) for t in columns["_text"]], "marked": columns["_marked"], "frames": [f for f, _, _ in found]}

    return save(in_tasks(rows, fields, work, ("_text", "_marked"), drop=(text, "_text", "_marked")), "frames")


def opened(frame: dict) -> bytes:
    return zstandard.ZstdDecompressor().decompress(frame["data"])


def read(frames: list[dict], lo: int, hi: int) -> Iterator[bytes]:
    """The bytes from lo to hi, a frame at a time; only frames that hold some of them are decompressed."""
    at = max(0, int(np.searchsorted([f["bytes"] for f in frames], lo, "right")) - 1)
    for frame in frames[at:]:
        if frame["bytes"] >= hi:
            return
        part = opened(frame)[max(0, lo - frame["bytes"]) : hi - frame["bytes"]]
        if part:
            yield part


def cut_at(frames: list[dict], k: int, n: int, whole: tuple[int, int]) -> tuple[int, int]:
    """(code points, bytes) before unit k, from the one frame that holds its start; `whole` is that of all n."""
    if k >= n or k == 0:
        return whole if k else (0, 0)
    frame = frames[int(np.searchsorted([f["units"] for f in frames], k, "right")) - 1]
    data = np.frombuffer(opened(frame), np.uint8)
    at = int(unit_starts(data, frame["in_word"])[k - frame["units"]])
    return frame["chars"] + int(np.count_nonzero((data[:at] & 0xC0) != 0x80)), frame["bytes"] + at


class Writer:
    """Frames in order: bytes are gathered and compressed, whole frames taken as they are."""

    def __init__(self) -> None:
        self.frames: list[dict] = []
        self.size = 0
        self.parts: list[bytes] = []
        self.held = 0
        self.press = zstandard.ZstdCompressor(level=LEVEL)

    def put(self, part: bytes) -> None:
        self.parts.append(part)
        self.held += len(part)
        if self.held >= FRAME:
            self.flush()

    def take(self, data: bytes, size: int) -> None:
        self.flush()
        self.frames.append({"bytes": self.size, "data": data})
        self.size += size

    def flush(self) -> None:
        if self.held:
            part, self.parts, self.held = b"".join(self.parts), [], 0
            self.frames.append({"bytes": self.size, "data": self.press.compress(part)})
            self.size += len(part)

    def copy(self, frames: list[dict], lo: int, hi: int, end: int) -> None:
        """The bytes from lo to hi of a text of `end` bytes."""
        starts = [f["bytes"] for f in frames]
        at = max(0, int(np.searchsorted(starts, lo, "right")) - 1)
        for i in range(at, len(frames)):
            first, last = starts[i], starts[i + 1] if i + 1 < len(frames) else end
            if first >= hi:
                return
            if lo <= first and last <= hi:
                self.take(frames[i]["data"], last - first)
            elif lo < last:
                self.put(opened(frames[i])[max(0, lo - first) : hi - first])


def draws(key: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the SHA-256 of `seed:key`, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(stored: DataFrame, key: str = "doc_id", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """stored with form (plain, psm, spm), prefix_chars, middle_chars, output_bytes and output: frames of the training text.

    rate percent of the texts are cut, and spm percent of these put the suffix first. The cuts are drawn among all units.
    """
    h1, h2, h3, h4 = draws(F.col(key), seed)
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | F.col("marked") | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    rows = stored.withColumns({"_form": form, "_from": F.least(first, second), "_to": F.greatest(first, second)})
    fields = [T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output_bytes", T.LongType()), T.StructField("output", OUTPUT)]
    p, s, m = (x.encode() for x in MARKS)

    def work(columns: Rows) -> Rows:
        out: Rows = {f.name: [] for f in fields}
        for kind, lo, hi, frames, n, chars, size in zip(*(columns[c] for c in needs)):
            w = Writer()
            if kind == "plain":
                w.copy(frames, 0, size, size)
                sizes = None, None
            else:
                (c1, b1), (c2, b2) = (cut_at(frames, k, n, (chars, size)) for k in (lo, hi))
                for mark, a, b in ((p, 0, b1), (s, b2, size), (m, b1, b2)) if kind == "psm" else ((s, b2, size), (p, 0, b1), (m, b1, b2)):
                    w.put(mark)
                    w.copy(frames, a, b, size)
                sizes = c1, c2 - c1
            w.flush()
            for name, value in zip(out, (kind, *sizes, w.size, w.frames)):
                out[name].append(value)
        return out

    needs = ("_form", "_from", "_to", "frames", "n", "n_chars", "n_bytes")
    made = in_tasks(rows, fields, work, needs, drop=("_form", "_from", "_to", "frames"))
    return made


def marks_at(frames: list[dict], size: int, wanted: list[bytes]) -> list[int]:
    """Where the markers stand, in this order; read a frame at a time."""
    out, tail, at = [], b"", 0
    for part in read(frames, 0, size):
        block, at = tail + part, at + len(part)
        lo = 0
        while len(out) < len(wanted) and (i := block.find(wanted[len(out)], lo)) >= 0:
            out.append(at - len(block) + i)
            lo = i + len(wanted[len(out) - 1])
        tail = block[max(lo, len(block) - 2) :]
    return out


def restored(form: str, frames: list[dict], size: int) -> Iterator[bytes]:
    """The text that an output was made from, in order, from the output and its form alone."""
    if form == "plain":
        yield from read(frames, 0, size)
        return
    p, s, m = (x.encode() for x in MARKS)
    order = [p, s, m] if form == "psm" else [s, p, m]
    at = marks_at(frames, size, order)
    spans = {mark: (a + len(mark), b) for mark, a, b in zip(order, at, [*at[1:], size])}
    for mark in (p, m, s):
        yield from read(frames, *spans[mark])


def digests(made: DataFrame) -> DataFrame:
    """made with output_sha256 and restored_sha256 in place of the output, streamed from its frames."""

    def work(columns: Rows) -> Rows:
        out: Rows = {"output_sha256": [], "restored_sha256": []}
        for form, frames, size in zip(columns["form"], columns["output"], columns["output_bytes"]):
            for name, parts in (("output_sha256", read(frames, 0, size)), ("restored_sha256", restored(form, frames, size))):
                h = hashlib.sha256()
                for part in parts:
                    h.update(part)
                out[name].append(h.hexdigest())
        return out

    fields = [T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    kept = made.withColumn("_form", F.col("form"))
    return in_tasks(kept, fields, lambda c: work({"form": c["_form"], "output": c["output"], "output_bytes": c["output_bytes"]}), ("_form", "output", "output_bytes"), drop=("_form", "output"))


def texts(made: DataFrame) -> DataFrame:
    """made with the output as a string, for writing training files."""
    kept = made.withColumn("_output", F.col("output"))
    fields = [T.StructField("output", T.StringType())]
    return in_tasks(kept, fields, lambda c: {"output": [b"".join(read(f, 0, n)).decode() for f, n in zip(c["_output"], c["output_bytes"])]}, ("_output", "output_bytes"), drop=("_output",))
