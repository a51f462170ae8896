"""Column functions over transcripts, tags and free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start: double, end: double, text: string, translated: string>>"


def timed_segments(json: Column) -> Column:
    """Segments with text and end > start; a block of 0 to 4 s with over 240 characters is no timing and goes."""
    return F.filter(F.from_json(json, SEGMENTS), lambda s: (F.length(F.trim(s["text"])) > 0) & (s["end"] > s["start"]) & ~((s["start"] <= 0) & (s["end"] <= 4) & (F.length(s["text"]) > 240)))


def vtt_time(seconds: Column) -> Column:
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(F.pmod(ms, F.lit(3_600_000)) / 60_000), F.floor(F.pmod(ms, F.lit(60_000)) / 1000), F.pmod(ms, F.lit(1000)))


def segments_to_vtt(segments: Column, mode: str = "text") -> Column:
    """WEBVTT text. mode: text, translated or both. A segment that ends before it starts lasts 4 s; without any, one empty cue."""

    def line(x: Column) -> Column:
        return F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def body(s: Column) -> Column:
        other = F.coalesce(s["translated"], s["text"])
        if mode == "both":
            return F.concat_ws("\n", line(s["text"]), F.when(s["translated"].isNotNull(), line(s["translated"])))
        return line(other if mode == "translated" else s["text"])

    cue = lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), vtt_time(s["start"]), F.lit(" --> "), vtt_time(F.when(s["end"] > s["start"], s["end"]).otherwise(s["start"] + 4)), F.lit("\n"), body(s))
    empty = F.lit("1\n00:00:00.000 --> 00:00:05.000\n")
    cues = F.when(F.coalesce(F.size(segments), F.lit(0)) > 0, F.array_join(F.transform(segments, cue), "\n\n")).otherwise(empty)
    return F.concat(F.lit("WEBVTT\n\n"), cues, F.lit("\n"))


def strip_markup_tokens(text: Column) -> Column:
    """(marks, clean): the names in `<|...|>`, none of them empty, and the text without them, with single spaces."""
    bare = F.regexp_replace(text, r"<\|[^|<>]+\|>", "")
    return F.struct(F.regexp_extract_all(text, F.lit(r"<\|([^|<>]+)\|>"), F.lit(1)).alias("marks"), F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")).alias("clean"))


def semantic_tokens(text: Column, longest: int = 48) -> Column:
    """Lower-case word tokens of two characters or more, cut at `longest`."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1)), lambda t: F.substring(F.regexp_replace(t, "^[_-]+|[_-]+$", ""), 1, longest))
    return F.filter(words, lambda t: F.length(t) >= 2)


def semantic_text(*fields: Column, longest: int = 4000) -> Column:
    """All fields that aren't empty as one string."""
    return F.substring(F.concat_ws(" ", *(F.nullif(F.trim(f), F.lit("")) for f in fields)), 1, longest)


def clean_filters(json: Column, allowed: Sequence[str]) -> Column:
    """Allowed keys with a value; null without an object."""
    return F.map_filter(F.from_json(json, "map<string,string>"), lambda k, v: k.isin(*allowed) & (F.length(v) > 0))


def saved_name(name: Column) -> Column:
    return F.substring(F.trim(name), 1, 80)
