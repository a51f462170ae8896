"""What tasks do with texts and vectors: words of a caller's table in texts, by built-in functions or Arrow batches, and vectors as matrices."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEW_WORDS = 32  # words that are looked for one by one, without Python


def found_words(rows: DataFrame, key: str, texts: Sequence[str], words: list[str]) -> DataFrame:
    """(key, word, place): each word that a text contains, once for each of the text columns (place is its number from 0).

    Up to FEW_WORDS words are looked for by `contains`, so that no text goes to Python. Beyond, one automaton holds all words, so
    that a text is read once, whatever their number; a Python worker holds batches of 10,000 texts or 64 MB at most. The caller
    bounds the words. Null texts contain nothing; the empty word is in every other text.
    """
    always = "" in words
    wanted = sorted({w for w in words if w})
    if 0 < len(set(words)) <= FEW_WORDS:
        tests = [F.struct(F.lit(w).alias("word"), F.lit(place).alias("place"), F.contains(F.col(t), F.lit(w)).alias("_hit")) for w in sorted(set(words)) for place, t in enumerate(texts)]
        return rows.select(key, *texts).select(key, F.inline(F.array(*tests))).where("_hit").drop("_hit")
    schema = T.StructType([rows.schema[key], T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in wanted:
            automaton.add_word(w, w)
        if wanted:
            automaton.make_automaton()
        for batch in batches:
            at, found, places = [], [], []
            for place in range(len(texts)):
                for i, text in enumerate(batch.column(place + 1)):
                    if (body := text.as_py()) is None:
                        continue
                    hits = {w for _, w in automaton.iter(body)} if wanted else set()
                    if always:
                        hits.add("")
                    at += [i] * len(hits)
                    found += sorted(hits)
                    places += [place] * len(hits)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(places, pa.int32())], [key, "word", "place"])

    return rows.select(key, *texts).mapInArrow(run, schema)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vector in a column of lists; null vectors have none, null components count as 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(np.asarray(column.is_valid()))
    full = column.drop_null()
    sizes = np.asarray(full.value_lengths()).astype(np.int64)
    values = full.flatten().cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        yield rows[own], values[(ends[own] - size)[:, None] + np.arange(size)]
