"""Column functions over file names, paths, times and durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
VIDEO_EXTENSIONS = ("mp4", "mkv", "mov", "avi", "webm", "m4v", "ts", "flv", "wmv")
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "heic")
LONGEST_NAME = 180
LONGEST_COMPONENT = 80
SEPARATORS = r"[_\-.()\[\]{}【】]+"
BETWEEN_TOKENS = r"\s+|,|，|、|\|"
NAME_DATE = r"20\d{2}[-_年.]?\d{1,2}[-_月.]?\d{1,2}"
NAME_RESOLUTION = r"(?:[1-9]\d{2,4})[xX×](?:[1-9]\d{2,4})|(?:2160|1440|1080|720)[pP]|4[kK]"
NAME_CODE = r"\b[A-Z]{2,6}[-_ ]?\d{2,6}\b"
CREATED = r"(20\d\d)[-:]?(\d\d)[-:]?(\d\d)[T _:]?(\d\d)?[:]?(\d\d)?[:]?(\d\d)?"  # a date, and as much of a time as there is
SAMPLE_BANDS = ((45, 3), (180, 5), (600, 8), (1800, 12))  # (seconds below, times)
MOST_BAND = 16


def media_type(ext: Column) -> Column:
    """video, photo or other by extension, with or without its dot; null is other."""
    bare = F.lower(F.regexp_replace(ext, r"^\.", ""))
    return F.when(bare.isin(*VIDEO_EXTENSIONS), "video").when(bare.isin(*PHOTO_EXTENSIONS), "photo").otherwise("other")


def normalized_text(text: Column) -> Column:
    """Runs of separators become single spaces; white space at the ends goes."""
    return F.regexp_replace(F.regexp_replace(text, SEPARATORS, " "), r"(?U)^\s+|\s+$", "")


def split_tokens(text: Column, longest: int = 40) -> Column:
    """Words of the normalized text between white space, commas and bars, without those over `longest`."""
    return F.filter(F.split(normalized_text(text), f"(?U){BETWEEN_TOKENS}"), lambda t: (F.length(t) > 0) & (F.length(t) <= longest))


def name_text(name: Column) -> Column:
    """The normalized text of a name without its folders and its extension, in which the patterns of names are searched."""
    return normalized_text(F.regexp_replace(F.regexp_extract(name, r"([^/]*)/*$", 1), r"(?s)^(.+)\.[^.]+$", "$1"))


def first_found(text: Column, pattern: str) -> Column:
    """The first place that the pattern hits, in whatever case and as it stands, or null."""
    return F.nullif(F.regexp_extract(text, f"(?iU){pattern}", 0), F.lit(""))


def name_date(name: Column) -> Column:
    """The first date from 2000 on. Dashes and dots are spaces by then, so its digits stand together or between the signs for year and month."""
    return first_found(name_text(name), NAME_DATE)


def name_resolution(name: Column) -> Column:
    """The first resolution in a name, by both sides or by lines, or null."""
    return first_found(name_text(name), NAME_RESOLUTION)


def name_quality(name: Column) -> Column:
    """4K before 1080P before 720P, whichever a name has, else its resolution, or null."""
    low = F.lower(name_text(name))
    return F.when(low.rlike("4k|2160p"), "4K").when(low.contains("1080p"), "1080P").when(low.contains("720p"), "720P").otherwise(name_resolution(name))


def name_code(name: Column) -> Column:
    """The first code of two to six letters and two to six digits, with or without a space between them, or null."""
    return first_found(name_text(name), NAME_CODE)


def first_rule(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The value of the first rule (pattern, value) that hits."""
    return F.coalesce(*(F.when(text.rlike(p), v) for p, v in rules)) if rules else F.lit(None).cast("string")


def parse_name(name: Column, platform_rules: Sequence[tuple[str, str]] = ()) -> Column:
    """A struct of date, resolution, code, quality and platform, all of them from the name_text; the rules' patterns meet it in lower case."""
    return F.struct(name_date(name).alias("date"), name_resolution(name).alias("resolution"), name_code(name).alias("code"), name_quality(name).alias("quality"), first_rule(F.lower(name_text(name)), platform_rules).alias("platform"))


def hash8_from_name(name: Column) -> Column:
    """The last eight hexadecimal digits of a name's stem, in lower case, with or without a separator and an extension, or null."""
    found = F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/]*)/*$", 1), r"([0-9A-Fa-f]{8})(?:\.[^.]+)?$", 1))
    return F.when(found != "", found)


def is_normalized_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^(VID|IMG)_[0-9]{8}.*_[0-9a-fA-F]{8}\.[A-Za-z0-9]+$"), F.lit(False))


def date_key(mtime: Column, created: Column) -> Column:
    """(key, origin): yyyyMMdd_HHmmss of the first date in the creation text, whose missing time is 000000, else of the
    modification time in UTC. The origin is metadata, mtime, or none, for which the key is NA."""
    day = F.concat(*(F.regexp_extract(created, CREATED, i) for i in (1, 2, 3)))
    time = F.concat(*(F.rpad(F.regexp_extract(created, CREATED, i), 2, "0") for i in (4, 5, 6)))
    own = F.when(F.length(day) > 0, F.concat_ws("_", day, time))
    return F.struct(F.coalesce(own, F.date_format(mtime, "yyyyMMdd_HHmmss"), F.lit("NA")).alias("key"), F.when(own.isNotNull(), "metadata").when(mtime.isNotNull(), "mtime").otherwise("none").alias("origin"))


def duration_slug(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s of whole seconds, given as a number or text; durNA without a number."""
    whole = seconds.try_cast("double").try_cast("long")
    h, m, s = F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60))
    slug = F.when(h != 0, F.format_string("%dh%02dm%02ds", h, m, s)).when(m != 0, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))
    return F.when(whole.isNotNull(), slug).otherwise("durNA")


def resolution_slug(width: Column, height: Column) -> Column:
    """1920x1080 of what both hold, as it is; resNA where one is null or empty."""
    w, h = width.cast("string"), height.cast("string")
    return F.when((F.length(w) > 0) & (F.length(h) > 0), F.concat_ws("x", w, h)).otherwise("resNA")


def safe_component(text: Column) -> Column:
    """A part of a path: no control or reserved characters, single spaces, no ends of ` ._-`, 80 characters at most."""
    clean = F.regexp_replace(F.regexp_replace(text, r'[\x00-\x1f\x7f<>:"/\\|?*]', ""), r"\s+", " ")
    return F.regexp_replace(F.substring(F.regexp_replace(clean, r"^[ ._-]+|[ ._-]+$", ""), 1, LONGEST_COMPONENT), r"[ ._-]+$", "")


def compact_token(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s_.-]+", "")


def is_junk_token(text: Column) -> Column:
    """Hexadecimal strings, digits, domains, dates, and lengths outside 2 to 32."""
    t = compact_token(text)
    junk = t.rlike(r"^[0-9]+$") | t.rlike(r"^[0-9a-f]{8,}$") | F.lower(text).rlike(r"\.(com|net|org|info|io)$") | F.lower(text).rlike(r"^[0-9]{4}[-_.][0-9]{1,2}[-_.][0-9]{1,2}$") | (F.length(t) < 2) | (F.length(t) > 32)
    return F.coalesce(junk, F.lit(True))


def flags_for(name: Column, probe_error: Column, promo: str, review: str) -> Column:
    """The flags of an item, in a fixed order; both patterns come from the caller."""
    return F.array_compact(
        F.array(
            F.when(name.rlike(promo), "promo"),
            F.when(F.length(name) > LONGEST_NAME, "very_long_name"),
            F.when(F.length(probe_error) > 0, "probe_error"),
            F.when(name.rlike(review), "review"),
        )
    )


def source_of_path(path: Column, review_dir: str = "review") -> Column:
    """The first part of a path, or the first three under the review folder."""
    parts = F.split(F.regexp_replace(path, r"^/+", ""), "/")
    return F.when(F.get(parts, F.lit(0)) == review_dir, F.array_join(F.slice(parts, 1, 3), "/")).otherwise(F.get(parts, F.lit(0)))


def parse_rate(rate: Column) -> Column:
    """"30000/1001" as 29.97 and "25" as 25.0, half-even at four places; null without a number or with a zero below the line."""
    parts = F.split(rate, "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0)).when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("double"))
    return F.bround(F.try_divide(top, bottom), 4)


def sample_points(duration: Column, least: int = 3, most: int = 18) -> Column:
    """Evenly spaced times inside a duration, from a margin of 5 % (2 s at most) to the same margin before the end.

    Their number goes by SAMPLE_BANDS, from least to most. Without a positive duration there are `least` times of 0, 8, 15
    and so on; a null duration has none.
    """
    banded = F.lit(None).cast("int")
    for below, n in SAMPLE_BANDS:
        banded = F.coalesce(banded, F.when(duration < below, n))
    n = F.greatest(F.lit(1), F.least(F.lit(max(3, most)), F.greatest(F.when(duration <= 0, least).otherwise(F.coalesce(banded, F.lit(MOST_BAND))), F.lit(least))))
    start = F.least(F.lit(2.0), duration * 0.05)
    spread = lambda i: F.least(duration - 0.25, start + (duration - start - start) * i / (n - 1))
    one = F.least(duration - 0.5, duration * 0.45)
    at = lambda i: F.when(duration <= 0, F.when(i > 0, i * 7.0 + 1).otherwise(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.when(n == 1, one).otherwise(spread(i))), 3))
    return F.when(duration.isNotNull(), F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))


def fill_probe(probed: Column, old: Column) -> Column:
    """The probed value where there is one, else the old."""
    return F.coalesce(probed, old)


def fill_resolution(width: Column, height: Column, old: Column) -> Column:
    """WxH of a probe that has both, neither of them 0, else the old resolution."""
    return F.when((width != 0) & (height != 0), F.concat_ws("x", width.cast("string"), height.cast("string"))).otherwise(old)
