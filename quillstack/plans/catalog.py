"""The catalog queries over the given tables, with their SQL.

Documents stand for items: doc_id is the id, source the root, n_chars the size, text the content; names, times and
probes are derived from them alike here and in ITEMS. Rule tables are small, neutral and made by the caller.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, texts
from ..operators import gate, joins, reports, search, tagging, vectors, windows
from ..session import table
from ..sources import readers
from ..streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ITEMS = """
base as (
  select doc_id as item_id, source as root, lang, n_chars as size_bytes, text, sha256(text) as sha256,
    case doc_id % 5 when 0 then 'mp4' when 1 then 'jpg' when 2 then 'mkv' when 3 then 'png' else 'txt' end as ext,
    timestamp '2024-01-01 00:00:00' + to_hours(doc_id::int) as mtime
  from documents
), named as (
  select *, case doc_id_mod
      when 0 then 'VID_2024' || lpad((item_id % 12 + 1)::varchar, 2, '0') || lpad((item_id % 28 + 1)::varchar, 2, '0') || '_' || lang || '_1920x1080_' || substr(sha256, 1, 8) || '.' || ext
      when 1 then lang || ' doc-' || (item_id % 1000 + 10)::varchar || ' 720p.' || ext
      else root || '_clip_' || item_id::varchar || '_4K.' || ext end as filename
  from (select *, item_id % 3 as doc_id_mod from base)
), items as (
  select item_id, root, lang, size_bytes, text, sha256, ext, mtime, filename, lang || '/' || filename as relative_path, root || '/' || lang || '/' || filename as path,
    case when ext in ('mp4', 'mkv') then 'video' when ext in ('jpg', 'png') then 'photo' else 'other' end as media_type,
    case when ext in ('mp4', 'mkv') and item_id % 11 <> 0 then (size_bytes % 4000)::double end as duration,
    case when item_id % 7 <> 0 then 1920 end as width, case when item_id % 7 <> 0 then 1080 end as height,
    case when regexp_matches(coalesce(text, ''), 'Licensed under|token = ') then 'review' else 'normal' end as review_state
  from named
), live as (select * from items where review_state = 'normal'),
rules(rule_order, category, tag, words) as (values (1, 'german', 'de', ['der ', 'und ']), (2, 'french', 'fr', ['les ', 'que ']), (3, 'format', 'hd', ['1080', '4k'])),
words as (select rule_order, category, tag, unnest(words) as word from rules),
tags as (
  select item_id, tag, min(category) as category, max(case when contains(lower(filename), word) then 0.92 else 0.78 end)::double as confidence, 'keyword' as source,
    case when max(case when contains(lower(filename), word) then 0.92 else 0.78 end) >= 0.85 then 'confirmed' else 'pending' end as state
  from live join words on contains(lower(filename), word) or contains(lower(coalesce(text, '')), word) group by item_id, tag
)"""
RULES = [(1, "german", "de", ["der ", "und "]), (2, "french", "fr", ["les ", "que "]), (3, "format", "hd", ["1080", "4k"])]


def query(sql: str | None = None, items: bool = True) -> Callable[[Query], Query]:
    """Registers a query, and its SQL with the items' tables before it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            if items:
                body = f"with recursive {ITEMS.strip()}{', ' + body[5:] if body.startswith('with ') else ' ' + body}"
            ORACLES[f.__name__] = body
        return f

    return add


def all_items(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    i = F.col("item_id")
    out = docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("root"), "lang", F.col("n_chars").alias("size_bytes"), "text", F.sha2("text", 256).alias("sha256"))
    out = out.withColumn("ext", F.get(F.array(*map(F.lit, ("mp4", "jpg", "mkv", "png", "txt"))), (i % 5).cast("int"))).withColumn("mtime", F.timestamp_seconds(1704067200 + i * 3600))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    name = (
        F.when(i % 3 == 0, F.concat(F.lit("VID_2024"), two(i % 12 + 1), two(i % 28 + 1), F.lit("_"), "lang", F.lit("_1920x1080_"), F.substring("sha256", 1, 8), F.lit("."), "ext"))
        .when(i % 3 == 1, F.concat("lang", F.lit(" doc-"), (i % 1000 + 10).cast("string"), F.lit(" 720p."), "ext"))
        .otherwise(F.concat("root", F.lit("_clip_"), i.cast("string"), F.lit("_4K."), "ext"))
    )
    out = out.withColumn("filename", name).withColumn("relative_path", F.concat_ws("/", "lang", "filename")).withColumn("path", F.concat_ws("/", "root", "lang", "filename"))
    out = out.withColumn("media_type", names.media_type(F.col("ext"))).withColumn("duration", F.when((F.col("media_type") == "video") & (i % 11 != 0), (F.col("size_bytes") % 4000).cast("double")))
    out = out.withColumn("width", F.when(i % 7 != 0, 1920)).withColumn("height", F.when(i % 7 != 0, 1080))
    return gate.review_gate(out, review_rules(spark), "text")


def review_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("licence", "Licensed under"), ("secret", "token = ")], "name string, pattern string")


def live_items(spark: SparkSession, d: str) -> DataFrame:
    return gate.passed(all_items(spark, d))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_order int, category string, tag string, words array<string>")


def all_tags(spark: SparkSession, d: str) -> DataFrame:
    return tagging.keyword_tags(live_items(spark, d), rule_table(spark))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, text): all turns of a conversation in order, a line each."""
    turns = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return turns.select("item_id", F.array_join("t.text", "\n").alias("text"))


@query("with u as (select media_type, size_bytes, row_number() over (partition by media_type, size_bytes, sha256 order by path, item_id) as rn from live where sha256 is not null) select media_type, count(*) as items, sum(size_bytes)::bigint as bytes from u where rn = 1 group by media_type")
def storage_after_dedupe(spark, d):
    return reports.storage_by_type(windows.mark_duplicates(live_items(spark, d)).where("duplicate_role <> 'candidate'"))


@query("select review_state, count(*) as items from items group by review_state")
def review_gate_counts(spark, d):
    return all_items(spark, d).groupBy("review_state").agg(F.count("*").alias("items"))


@query("select media_type, count(*) as items, sum(size_bytes)::bigint as bytes from live group by media_type")
def storage_by_type(spark, d):
    return reports.storage_by_type(all_items(spark, d))


@query(r"""
with s as (select *, trim(regexp_replace(regexp_replace(filename, '\.[^.]+$', ''), '[_\-.()\[\]{}【】]+', ' ', 'g')) as t from live),
p as (select *, nullif(regexp_extract(t, '20\d{2}[-_年.]?\d{1,2}[-_月.]?\d{1,2}'), '') as date, nullif(regexp_extract(t, '[1-9]\d{2,4}[xX×][1-9]\d{2,4}|(2160|1440|1080|720)[pP]|4[kK]'), '') as resolution,
  nullif(regexp_extract(t, '(?i)\b[A-Z]{2,6}[-_ ]?\d{2,6}\b'), '') as code from s)
select item_id, media_type, date, resolution, code,
  case when regexp_matches(t, '4[kK]|2160[pP]') then '4K' when regexp_matches(t, '1080[pP]') then '1080P' when regexp_matches(t, '720[pP]') then '720P' else resolution end as quality,
  case when regexp_matches(lower(t), '^vid ') then 'camera' when contains(lower(t), 'clip') then 'editor' end as platform,
  nullif(lower(regexp_extract(filename, '([0-9A-Fa-f]{8})(\.[^.]+)?$', 1)), '') as hash8,
  regexp_matches(filename, '^(VID|IMG)_[0-9]{8}.*_[0-9a-fA-F]{8}\.[A-Za-z0-9]+$') as normalized
from p""")
def names_parsed(spark, d):
    f = F.col("filename")
    rows = live_items(spark, d).select("item_id", "media_type", names.parse_name(f, [("^vid ", "camera"), ("clip", "editor")]).alias("p"), names.hash8_from_name(f).alias("hash8"), names.is_normalized_name(f).alias("normalized"))
    return rows.select("item_id", "media_type", "p.date", "p.resolution", "p.code", "p.quality", "p.platform", "hash8", "normalized")


@query(r"""
select item_id, case when duration is not null then case when duration >= 3600 then (duration::bigint // 3600)::varchar || 'h' || lpad((duration::bigint % 3600 // 60)::varchar, 2, '0') || 'm' || lpad((duration::bigint % 60)::varchar, 2, '0') || 's'
    when duration >= 60 then (duration::bigint // 60)::varchar || 'm' || lpad((duration::bigint % 60)::varchar, 2, '0') || 's' else (duration::bigint)::varchar || 's' end else 'durNA' end as duration_slug,
  case when width is not null and height is not null then width::varchar || 'x' || height::varchar else 'resNA' end as resolution_slug,
  case when item_id % 4 = 0 then strftime(mtime, '%Y%m%d') || '_000000' else strftime(mtime, '%Y%m%d_%H%M%S') end as date_key, case when item_id % 4 < 2 then 'metadata' else 'mtime' end as origin, root as top, regexp_replace(substr(regexp_replace(filename, '^[ ._-]+|[ ._-]+$', '', 'g'), 1, 80), '[ ._-]+$', '') as safe_name
from live""")
def name_slugs(spark, d):
    created = F.when(F.col("item_id") % 4 == 0, F.date_format("mtime", "yyyy-MM-dd")).when(F.col("item_id") % 4 == 1, F.date_format("mtime", "yyyy:MM:dd HH:mm:ss"))
    rows = live_items(spark, d).withColumn("k", names.date_key(F.col("mtime"), created))
    return rows.select("item_id", names.duration_slug(F.col("duration")).alias("duration_slug"), names.resolution_slug(F.col("width"), F.col("height")).alias("resolution_slug"), F.col("k.key").alias("date_key"), F.col("k.origin").alias("origin"), names.source_of_path(F.col("path")).alias("top"), names.safe_component(F.col("filename")).alias("safe_name"))


@query(r"""
with t as (select page_id, unnest(string_split_regex(regexp_replace(url, '[_\-.()\[\]{}【】]+', ' ', 'g'), '\s+|,|，|、|\|')) as token from pages),
j as (select token, lower(token) as c from t where length(token) between 1 and 40)
select token, count(*) as n, (regexp_matches(c, '^[0-9]+$') or regexp_matches(c, '^[0-9a-f]{8,}$') or length(c) < 2 or length(c) > 32) as junk from j group by token, c""", items=False)
def url_tokens(spark, d):
    tokens = table(spark, d, "pages").select(F.explode(names.split_tokens(F.col("url"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("junk", names.is_junk_token(F.col("token")))


@query("select item_id, list_filter([case when regexp_matches(filename, 'clip') then 'promo' end, case when ext = 'txt' then 'probe_error' end, case when regexp_matches(filename, '^fr ') then 'review' end], lambda x: x is not null)::varchar as flags from live")
def name_flags(spark, d):
    flags = names.flags_for(F.col("filename"), F.when(F.col("ext") == "txt", "no probe"), "clip", "^fr ")
    return live_items(spark, d).select("item_id", F.concat(F.lit("["), F.array_join(flags, ", "), F.lit("]")).alias("flags"))


@query("""
with n as (select item_id, duration, case when duration <= 0 then 3 when duration < 45 then 3 when duration < 180 then 5 when duration < 600 then 8 when duration < 1800 then 12 else 16 end as k, least(2.0::double, duration * 0.05) as margin from live where duration is not null),
i as (select *, unnest(range(0, k)) as i from n)
select item_id, i + 1 as idx, case when duration <= 0 then case when i = 0 then 0.0 else i * 7.0 + 1 end else round(greatest(0.0, least(duration - 0.25, margin + (duration - margin - margin) * i / (k - 1))), 3) end::double as at from i""")
def sample_points(spark, d):
    rows = live_items(spark, d).select("item_id", F.posexplode(names.sample_points(F.col("duration"))).alias("i", "at"))
    return rows.select("item_id", (F.col("i") + 1).cast("long").alias("idx"), "at")


@query("select o_orderkey, round_even(case when o_custkey % 13 = 0 then null else (o_custkey * 1000.0) / 1001 end, 4) as fps from orders", items=False)
def parse_rates(spark, d):
    return table(spark, d, "orders").select("o_orderkey", names.parse_rate(F.when(F.col("o_custkey") % 13 != 0, F.concat((F.col("o_custkey") * 1000).cast("string"), F.lit("/1001")))).alias("fps"))


@query("""
with c as (select conv_id, turn, text from conversations where text is not null and length(trim(text)) > 0 and not (turn = 0 and 4 * turn + 4 <= 4 and length(text) > 240))
select conv_id, count(*) as segments, min(turn * 4)::double as first_start, max(turn * 4 + 4)::double as last_end from c group by conv_id""", items=False)
def timed_segments(spark, d):
    rows = table(spark, d, "conversations")
    segs = rows.groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct((F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 4).alias("end"), "text")))).alias("json"))
    good = segs.select("conv_id", F.explode(texts.timed_segments(F.col("json"))).alias("s"))
    return good.groupBy("conv_id").agg(F.count("*").alias("segments"), F.min("s.start").alias("first_start"), F.max("s.end").alias("last_end"))


@query("""
with c as (select conv_id, turn * 4 as s, text, row_number() over (partition by conv_id order by turn, text) as n from conversations),
q as (select conv_id, n, n::varchar || chr(10) || printf('%02d:%02d:%02d.000', s // 3600, s % 3600 // 60, s % 60) || ' --> ' || printf('%02d:%02d:%02d.000', (s + 4) // 3600, (s + 4) % 3600 // 60, (s + 4) % 60) || chr(10)
  || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as cue from c)
select conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(cue, chr(10) || chr(10) order by n) || chr(10) as vtt from q group by conv_id""", items=False)
def segments_to_vtt(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 4).alias("end"), "text", F.lit(None).cast("string").alias("translated")))).alias("s"))
    return rows.select("conv_id", texts.segments_to_vtt(F.col("s")).alias("vtt"))


@query(r"""
with r as (select conv_id, turn, '<|' || role || '|>  ' || coalesce(text, '') || ' <|turn' || turn::varchar || '|>' as raw from conversations)
select conv_id, turn, array_to_string(regexp_extract_all(raw, '<\|([^|<>]+)\|>', 1), ',') as marks, trim(regexp_replace(regexp_replace(raw, '<\|[^|<>]+\|>', '', 'g'), '\s+', ' ', 'g')) as clean from r""", items=False)
def markup_tokens(spark, d):
    raw = F.concat(F.lit("<|"), "role", F.lit("|>  "), F.coalesce("text", F.lit("")), F.lit(" <|turn"), F.col("turn").cast("string"), F.lit("|>"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", texts.strip_markup_tokens(raw).alias("x"))
    return rows.select("conv_id", "turn", F.array_join("x.marks", ",").alias("marks"), "x.clean")


@query(r"""
with t as (select item_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_-]+)', 1)) as w from live),
c as (select item_id, substr(regexp_replace(w, '^[_-]+|[_-]+$', '', 'g'), 1, 48) as w from t)
select item_id, count(*) as tokens, count(distinct w) as words from c where length(w) >= 2 group by item_id""")
def semantic_tokens(spark, d):
    rows = live_items(spark, d).select("item_id", F.array(texts.semantic_tokens(F.col("text"))).alias("w"))
    sizes = lambda w: F.struct(F.size(w).cast("long").alias("tokens"), F.size(F.array_distinct(w)).cast("long").alias("words"))
    return rows.select("item_id", F.inline(F.transform("w", sizes))).where("tokens > 0")  # a filter isn't moved below inline, so the words are cut once


@query("select l.item_id, sha256(substr(concat_ws(' ', filename, nullif(trim(t.text), ''), g.tags), 1, 4000)) as digest from live l left join (select conv_id as item_id, string_agg(text, chr(10) order by turn, text) as text from conversations group by conv_id) t using (item_id) left join (select item_id, string_agg(tag, ',' order by tag) as tags from tags group by item_id) g using (item_id)")
def semantic_texts(spark, d):
    both = live_items(spark, d).select("item_id", "filename").join(transcripts(spark, d), "item_id", "left").join(reports.tags_concat(all_tags(spark, d)), "item_id", "left")
    return both.select("item_id", F.sha2(texts.semantic_text(F.col("filename"), F.col("text"), F.col("tags")), 256).alias("digest"))


@query("select event_id, nullif(json_extract_string(props, '$.page'), '') as page from events", items=False)
def clean_filters(spark, d):
    kept = texts.clean_filters(F.col("props"), ["page"])
    return table(spark, d, "events").select("event_id", F.try_element_at(kept, F.lit("page")).alias("page"))


@query("""
with hit as (select distinct item_id from tags where contains(lower(tag), 'hd'))
select item_id, filename from live where media_type = 'video' and duration >= 100 and duration <= 3000 and item_id in (select item_id from hit) and (contains(lower(filename), 'en') or contains(lower(path), 'en') or item_id in (select item_id from tags where contains(tag, 'en')) or item_id in (select item_id from (select conv_id as item_id, string_agg(text, chr(10) order by turn, text) as text from conversations group by conv_id) where contains(lower(text), 'en')))""")
def catalog_query(spark, d):
    found = search.catalog_query(all_items(spark, d), all_tags(spark, d), transcripts(spark, d), media_type="video", tag_terms=["HD"], duration=(100, 3000), text="EN")
    return found.select("item_id", "filename")


@query("""
with g as (select item_id, string_agg(tag, ',' order by tag) as tags from tags where state <> 'rejected' group by item_id)
select item_id, filename, tags, ((item_id % 2147483647) * 1103515245 + 7) % 2147483647 as shuffle_key from live left join g using (item_id)
where (contains(filename, 'x1080') or contains(filename, '1080P')) and item_id not in (select item_id from tags where tag = 'fr' and state <> 'rejected') order by shuffle_key, item_id limit 50""")
def catalog_page(spark, d):
    f = F.col("filename")
    items = all_items(spark, d).withColumn("resolution", names.name_resolution(f)).withColumn("quality", names.name_quality(f))
    found = search.catalog_query(items, all_tags(spark, d), transcripts(spark, d), without="fr", resolution="X1080", page=(7, 50), show_tags=True)
    return found.select("item_id", "filename", "tags", "shuffle_key")


@query("select 'orders' as source_table, o_orderkey as id from orders where contains(lower(o_orderpriority), 'urgent') union all select 'customer', c_custkey from customer where contains(lower(c_mktsegment), 'urgent')", items=False)
def manifest_search(spark, d):
    orders = gate.review_gate(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority"), review_rules(spark), "o_orderpriority")
    customers = gate.review_gate(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), review_rules(spark), "c_mktsegment")
    return search.manifest_search({"orders": orders, "customer": customers}, "URGENT").select("source_table", "id")


@query("select item_id, media_type from live where (media_type in ('video', 'photo') and (width is null or height is null)) or (media_type = 'video' and duration is null)")
def missing_probe(spark, d):
    return readers.missing_probe(live_items(spark, d)).select("item_id", "media_type")


@query("select item_id from live where sha256 is null or item_id % 9 < 2")
def missing_hash(spark, d):
    hashed = F.when(F.col("item_id") % 9 == 1, "").when(F.col("item_id") % 9 > 1, F.col("sha256"))
    return readers.missing_hash(live_items(spark, d).withColumn("sha256", hashed)).select("item_id")


@query("""
with p as (select user_id as item_id, ts, case when event_id % 7 <> 0 then (event_id % 5 * 640)::int end as w, (event_id % 3 * 360)::int as h, case when event_id % 4 <> 0 then value end as dur from events where event_id % 11 <> 0),
g as (select * from p qualify row_number() over (partition by item_id order by ts desc, w desc nulls last, h desc nulls last, dur desc nulls last) = 1)
select item_id, review_state, coalesce(w, width) as width, coalesce(h, height) as height, coalesce(dur, duration) as duration, case when w <> 0 and h <> 0 then w::varchar || 'x' || h::varchar when item_id % 2 = 0 then '800x600' end as resolution from items left join g using (item_id)""")
def fill_probes(spark, d):
    items = all_items(spark, d).select("item_id", "review_state", "width", "height", "duration", F.when(F.col("item_id") % 2 == 0, "800x600").alias("resolution"))
    i = F.col("event_id")
    status = F.when(i % 11 == 0, "failed").when(i % 2 == 0, "ok").otherwise("partial").alias("status")
    sides = F.when(i % 7 != 0, (i % 5 * 640).cast("int")).alias("width"), (i % 3 * 360).cast("int").alias("height")
    probes = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("ts").alias("probed_at"), status, *sides, F.when(i % 4 != 0, F.col("value")).alias("duration"))
    return joins.fill_probes(items, probes)


@query("select item_id, filename from live where item_id in (select doc_id from labels where toxic is distinct from 1) or (item_id in (select item_id from tags where tag = 'hd') and item_id not in (select doc_id from labels where toxic = 1))")
def items_with_tag(spark, d):
    items = all_items(spark, d)
    return search.with_tag(items, tagging.feedback_overlay(all_tags(spark, d), feedback(spark, d)), "hd").select("item_id", "filename")


@query("select item_id from live where item_id not in (select item_id from (select conv_id as item_id, string_agg(text, chr(10) order by turn, text) as text from conversations group by conv_id) where length(text) > 100)")
def needs_timed_rerun(spark, d):
    rows = transcripts(spark, d)
    timed = F.when(F.length("text") > 100, F.array("text")).otherwise(F.array().cast("array<string>"))
    return search.needs_timed_rerun(live_items(spark, d), rows, timed, F.lit(False)).select("item_id")


@query("select i.item_id from live i left join (select user_id as item_id, max(value / 100.0) as best from events group by user_id) e using (item_id) where best is null or best < 0.62")
def low_confidence(spark, d):
    labels = table(spark, d, "events").select(F.col("user_id").alias("item_id"), (F.col("value") / 100.0).alias("score"))
    return search.low_confidence(live_items(spark, d), labels).select("item_id")


@query("select item_id, tag, category, confidence, state from tags")
def keyword_tags(spark, d):
    return all_tags(spark, d).select("item_id", "tag", "category", "confidence", "state")


@query("select item_id, arg_min(category, rule_order) as category from live join words on contains(lower(coalesce(text, '')), word) group by item_id")
def first_category(spark, d):
    return tagging.first_category(live_items(spark, d), rule_table(spark), F.coalesce("text", F.lit("")))


@query("select item_id, string_agg(tag, ',' order by tag) as tags from tags group by item_id")
def tags_concat(spark, d):
    return reports.tags_concat(all_tags(spark, d))


@query("select tag, category, count(distinct item_id) as items, round(avg(confidence), 6) as confidence from tags group by tag, category order by items desc, tag, category limit 20")
def tag_stats(spark, d):
    return reports.tag_stats(all_tags(spark, d), 20).withColumn("confidence", F.round("confidence", 6))


@query("""
with own as (select distinct l_orderkey as item, 't' || (l_partkey % 300)::varchar as tag from lineitem),
top as (select tag, count(*) as n from own group by tag order by n desc, tag limit 100),
o as (select * from own where tag in (select tag from top))
select a.tag as tag_a, b.tag as tag_b, count(*) as weight from o a join o b on a.item = b.item and a.tag < b.tag group by 1, 2 having count(*) >= 2 order by weight desc, tag_a, tag_b limit 500""", items=False)
def tag_cooccurrence(spark, d):
    tags = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.concat(F.lit("t"), (F.col("l_partkey") % 300).cast("string")).alias("tag"), F.lit("confirmed").alias("state"))
    return reports.tag_cooccurrence(tags, 100, 2, 500)


@query("""
with w as (select unnest(regexp_extract_all(lower(text), '([A-Za-z]{3,}|[\\x{4e00}-\\x{9fff}]{2,})', 1)) as word from live)
select word, count(*) as n from w where word not in ('the', 'and') group by word having count(*) >= 2""")
def word_counts(spark, d):
    return reports.word_counts(live_items(spark, d), least=2, stop=spark.createDataFrame([("the",), ("and",)], "word string"))


@query("""
with h as (select 'x' as k, unnest([lang, root]) as tag from live), c as (select tag, count(*) as n from h group by tag)
select c.tag, n, coalesce(arg_min(category, rule_order), 'noise') as category from c left join (values (1, 'language', 'fr'), (2, 'batch', 'src1')) r(rule_order, category, word) on contains(c.tag, word) group by c.tag, n""")
def hashtag_counts(spark, d):
    rows = live_items(spark, d).select("review_state", F.concat(F.lit("#"), "lang", F.lit(" #"), "root").alias("text"))
    return reports.hashtag_counts(rows, spark.createDataFrame([(1, "language", ["fr"]), (2, "batch", ["src1"])], "rule_order int, category string, words array<string>"))


COVERAGE = """
with c(id, ready, total) as (
  select 'hash', count(*) filter (where sha256 is not null), count(*) from live union all
  select 'probe', count(*) filter (where media_type <> 'other' and width is not null), count(*) filter (where media_type <> 'other') from live union all
  select 'duration', count(*) filter (where media_type = 'video' and duration > 1000), count(*) filter (where media_type = 'video') from live union all
  select 'none', 0, 0
), p as (select id, ready, total, (case when total > 0 then least(100, greatest(0, round_even(ready * 100.0 / total, 0))) else 0 end)::int as percent from c)
"""


def coverage(spark: SparkSession, d: str) -> DataFrame:
    video = F.col("media_type") == "video"
    return reports.coverage_report(
        live_items(spark, d),
        {"hash": (F.lit(True), F.col("sha256").isNotNull()), "probe": (F.col("media_type") != "other", F.col("width").isNotNull()), "duration": (video, F.coalesce(F.col("duration") > 1000, F.lit(False))), "none": (F.lit(False), F.lit(True))},
    )


@query(COVERAGE + "select * from p")
def coverage_report(spark, d):
    return coverage(spark, d)


@query(COVERAGE + "select id, ready, total, percent, case when percent >= 50 then 'warning' else 'error' end as level from p where percent < 90")
def recommendations(spark, d):
    return reports.recommendations(coverage(spark, d))


@query(COVERAGE + "select m.id, coalesce(total, 0)::bigint as total, coalesce(percent, 0)::int as percent, minimum, coalesce(total, 0) = 0 or percent >= minimum as passed from (values ('hash', 95), ('probe', 90), ('duration', 50), ('absent', 90)) m(id, minimum) left join p using (id)")
def quality_gate(spark, d):
    minima = spark.createDataFrame([("hash", 95), ("probe", 90), ("duration", 50), ("absent", 90)], "id string, minimum int")
    return reports.quality_gate(coverage(spark, d), minima)


@query("""
with f as (select doc_id as item_id, 'good' as tag, case when quality = 1 then 1 else -1 end as verdict from labels union all select doc_id, 'hd', case when toxic = 1 then -1 else 1 end from labels)
, j as (select t.*, f.verdict from tags t left join f using (item_id, tag))
select item_id, tag, category, confidence, source, case when verdict = -1 then 'rejected' else state end as state from j where not (coalesce(verdict, 0) = 1 and source = 'manual')
union all select item_id, tag, 'feedback', 1.0, 'manual', 'confirmed' from f where verdict = 1""")
def feedback_overlay(spark, d):
    return tagging.feedback_overlay(all_tags(spark, d), feedback(spark, d))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    at = F.lit("2024-06-01").cast("timestamp").alias("updated_at")
    good = labels.select(F.col("doc_id").alias("item_id"), F.lit("good").alias("tag"), F.lit("feedback").alias("category"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("verdict"), at)
    return good.union(labels.select("doc_id", F.lit("hd"), F.lit("feedback"), F.when(F.col("toxic") == 1, -1).otherwise(1), at))


@query("select item_id, tag, source, state from tags union all select doc_id, 'favourite', 'manual', 'confirmed' from labels where quality = 1")
def favorite_overlay(spark, d):
    wanted = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), (F.col("quality") == 1).alias("on"))
    return tagging.favorite_overlay(all_tags(spark, d), wanted).select("item_id", "tag", "source", "state")


@query("""
with n as (select doc_id as item_id from labels where toxic = 0)
select item_id, tag, source from tags where item_id not in (select item_id from n) union all select item_id, 'checked', 'keyword' from n""")
def upsert_tags(spark, d):
    new = table(spark, d, "labels").where("toxic = 0").select(F.col("doc_id").alias("item_id"), F.lit("checked").alias("tag"), F.lit("x").alias("category"), F.lit(1.0).alias("confidence"), F.lit("keyword").alias("source"), F.lit("confirmed").alias("state"))
    return tagging.upsert_tags(all_tags(spark, d), new, ["keyword"]).select("item_id", "tag", "source")


@query("""
with b as (select user_id as item_id, event_type as tag, max(coalesce(try_cast(case when event_id % 17 = 0 then 'bad' else round(value / 100.0, 4)::varchar end as double), 0)) as confidence from events group by 1, 2)
select item_id, tag, round(confidence, 4) as confidence, case when confidence >= 0.7 then 'confirmed' else 'pending' end as state from b""", items=False)
def import_labels(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("label"), F.when(F.col("event_id") % 17 == 0, "bad").otherwise(F.round(F.col("value") / 100.0, 4).cast("string")).alias("score"))
    return tagging.import_labels(rows).select("item_id", "tag", F.round("confidence", 4).alias("confidence"), "state")


@query("""
with k as (select key, min(item_id) as item_id from (select item_id, unnest([relative_path, concat_ws('/', root, relative_path)]) as key from live) where key is not null group by key),
b as (select k.item_id, i.lang as tag, max(i.size_bytes % 100 / 100.0)::double as confidence from live i join k on k.key = case when i.item_id % 2 = 0 then i.relative_path else i.path end group by 1, 2)
select item_id, tag, confidence, case when confidence >= 0.7 then 'confirmed' else 'pending' end as state from b""")
def import_labels_by_path(spark, d):
    items = live_items(spark, d)
    rows = items.select(F.when(F.col("item_id") % 2 == 0, F.col("relative_path")).otherwise(F.col("path")).alias("media_path"), F.col("lang").alias("label"), (F.col("size_bytes") % 100 / 100.0).cast("string").alias("score"))
    return tagging.import_labels_by_path(rows, items).select("item_id", "tag", "confidence", "state")


@query("""
with s as (select user_id as item_id, event_type as label, event_id as frame, round(value, 4) as score from events),
f as (select item_id, count(distinct frame) as frames from s group by item_id),
o as (select item_id, label, avg(score) as mean, count(*) as n, max_by(frame, (score, -frame)) as frame from s group by item_id, label),
p as (select item_id, label, mean * (0.75 + 0.25 * least(1.0, n::double / least(3, frames))) as score, frame from o join f using (item_id))
select item_id, label, round(score + 1e-7, 4) as score, frame from p qualify row_number() over (partition by item_id order by score desc, label) = 1""", items=False)
def pool_label_scores(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("label"), F.col("event_id").alias("frame"), F.round("value", 4).alias("score"))
    return tagging.pool_label_scores(rows).withColumn("score", F.round(F.col("score") + 1e-7, 4))


@query("select 'good' as tag, count(*) filter (where quality = 1) as n_pos, count(*) filter (where quality <> 1) as n_neg from labels union all select 'hd', count(*) filter (where toxic <> 1), count(*) filter (where toxic = 1) from labels", items=False)
def centroid_status(spark, d):
    return tagging.centroid_status(feedback(spark, d))


CENTROIDS = """
with v as (select vec_id as item_id, embedding::double[] as vector, label from embeddings where vec_id in (select item_id from live)),
f as (select vec_id as item_id, 'low' as tag, case when label < 3 then 1 else -1 end as verdict from embeddings),
x as (select verdict, unnest(vector) as x, generate_subscripts(vector, 1) as dim from v join f using (item_id)),
m as (select verdict, dim, avg(x) as x from x group by 1, 2),
c as (select verdict, list(x order by dim) as raw from m group by verdict),
u as (select verdict, list_transform(raw, lambda y: y / sqrt(list_dot_product(raw, raw))) as c from c),
s as (select item_id, 1 / (1 + exp(-8 * (list_dot_product(vector, p.c) - list_dot_product(vector, n.c)))) as score from v, (select c from u where verdict = 1) p, (select c from u where verdict = -1) n)
"""


def centroid_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = all_items(spark, d)
    rows = table(spark, d, "embeddings")
    v = rows.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))
    f = rows.select(F.col("vec_id").alias("item_id"), F.lit("low").alias("tag"), F.when(F.col("label") < 3, 1).otherwise(-1).alias("verdict"))
    return items, v, tagging.train_centroids(items, v, f)


@query(CENTROIDS + "select 'low' as tag, unnest(range(1, len(p.c) + 1)) as dim, round(unnest(p.c), 6) as positive, round(unnest(n.c), 6) as negative from (select c from u where verdict = 1) p, (select c from u where verdict = -1) n")
def train_centroids(spark, d):
    rows = centroid_parts(spark, d)[2].select("tag", F.posexplode(F.arrays_zip("positive", "negative")).alias("i", "z"))
    return rows.select("tag", (F.col("i") + 1).cast("long").alias("dim"), F.round("z.positive", 6).alias("positive"), F.round("z.negative", 6).alias("negative"))


@query(CENTROIDS + "select item_id, 'low' as tag, round(score, 5) as confidence, case when score >= 0.76 then 'confirmed' else 'pending' end as state from s where score >= 0.62")
def apply_centroids(spark, d):
    return tagging.apply_centroids(*centroid_parts(spark, d)).select("item_id", "tag", F.round("confidence", 5).alias("confidence"), "state")


@query("""
with g as (select item_id, count(*) over w as n, row_number() over (partition by media_type, size_bytes, sha256 order by path, item_id) as rn from live window w as (partition by media_type, size_bytes, sha256))
select item_id, case when n = 1 then 'single' when rn = 1 then 'keep' else 'candidate' end as duplicate_role from g""")
def mark_duplicates(spark, d):
    return windows.mark_duplicates(live_items(spark, d)).select("item_id", "duplicate_role")


@query("""
with k as (select path, regexp_replace(filename, '[_-][0-9A-Fa-f]{8}(\\.[A-Za-z0-9]+)$', '\\1') || ':' || size_bytes::varchar as cheap_key, md5(text) as digest from (select lang || '.' || ext as filename, path, size_bytes, text from live))
select path, digest, row_number() over (partition by cheap_key, digest order by path) as rank from k where cheap_key in (select cheap_key from k group by cheap_key having count(*) > 1)""")
def two_stage_dedupe(spark, d):
    files = live_items(spark, d).select("path", "review_state", F.concat_ws(".", "lang", "ext").alias("filename"), "size_bytes", F.col("text").cast("binary").alias("content"))
    return windows.two_stage_dedupe(files).select("path", "digest", "rank")


TIMELINE = """
with e as (select user_id as item_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, case when event_id % 9 = 0 then null else (row_number() over (partition by user_id order by ts, event_id) - 1) * 5.0 end as t, case when event_type = 'click' then '' else event_type end as ref from events),
s as (select item_id, idx, coalesce(t, idx * 7.0)::double as start, ref from e),
l as (select item_id, idx, start, ref, (case when lead(start) over w is null then start + 7 else greatest(start + 1, lead(start) over w) end)::double as "end" from s window w as (partition by item_id order by idx))
"""
REFS = """, r as (select *, row_number() over (partition by item_id order by start, idx) as rn from l where ref <> ''),
x as (select item_id, string_agg(ref, '|' order by rn) as signature from r where rn <= 3 group by item_id)
"""
DHASH = """v as (select vec_id, list_transform(range(0, 72), lambda i: embedding[i % len(embedding) + 1]) as g from embeddings),
b as (select vec_id, unnest(range(0, 64)) as i, g from v), c as (select vec_id, i, (g[i // 8 * 9 + i % 8 + 1] > g[i // 8 * 9 + i % 8 + 2])::int as bit from b),
h as (select vec_id, i // 4 as k, sum(bit * (8 // (1 << (i % 4)::int)))::int as n from c group by 1, 2),
p as (select vec_id as item_id, string_agg(substr('0123456789abcdef', n + 1, 1), '' order by k) as signature from h group by vec_id)"""
FRAMES = """, q as (select l.item_id, p.signature as hash, row_number() over (partition by l.item_id order by start, idx) as rn from l join p on p.item_id = length(ref) where ref <> ''),
y as (select item_id, string_agg(hash, '|' order by rn) as signature from q where rn <= 3 group by item_id)
"""
SIMILAR = TIMELINE + ", " + DHASH + FRAMES + """,
a as (select 'exact' as kind, coalesce(size_bytes::varchar, '') || ':' || sha256 as signature, item_id, path, size_bytes from live
union all select 'image_phash', p.signature, live.item_id, path, size_bytes from live join p using (item_id) where media_type = 'photo'
union all select 'video_fingerprint', y.signature, live.item_id, path, size_bytes from live join y using (item_id) where media_type = 'video'),
g as (select *, count(*) over (partition by kind, signature) as members, row_number() over (partition by kind, signature order by size_bytes desc, path, item_id) as rn from a where signature <> ''),
i as (select kind, signature, item_id, path, size_bytes, members, case when rn = 1 then 'keep' else 'candidate' end as role from g where members > 1)
"""


def similar(spark: SparkSession, d: str) -> DataFrame:
    """Three kinds: size and hash of the whole text; dhash of photos with a grid; dhashes of the first frames of videos with a timeline."""
    rows = live_items(spark, d)
    photos = rows.where("media_type = 'photo'").join(dhashes(spark, d).withColumnRenamed("vec_id", "item_id"), "item_id")
    videos = rows.where("media_type = 'video'").join(fingerprints(spark, d).withColumnRenamed("signature", "prints"), "item_id")
    exact = windows.similarity_index(rows, "exact", F.concat(F.coalesce(F.col("size_bytes").cast("string"), F.lit("")), F.lit(":"), "sha256"))
    return exact.union(windows.similarity_index(photos, "image_phash", F.col("dhash"))).union(windows.similarity_index(videos, "video_fingerprint", F.col("prints")))


@query(SIMILAR + "select kind, signature, item_id, members, role from i")
def similarity_index(spark, d):
    return similar(spark, d).select("kind", "signature", "item_id", "members", "role")


@query(SIMILAR + ", t as (select kind, signature, count(*) as n from i group by 1, 2 order by n desc, kind, signature limit 10) select signature, item_id, row_number() over (partition by kind, signature order by role = 'candidate', size_bytes desc, path, item_id) as position from i where (kind, signature) in (select kind, signature from t)")
def similarity_listing(spark, d):
    return windows.similarity_listing(similar(spark, d), 10).select("signature", "item_id", "position")


def timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    refs = F.transform("e", lambda x: F.when(x["event_type"] == "click", "").otherwise(x["event_type"]))
    times = F.transform("e", lambda x, i: F.when(x["event_id"] % 9 != 0, i * F.lit(5.0)))
    return windows.timeline_segments(rows.select(F.col("user_id").alias("item_id"), refs.alias("refs"), times.alias("times")))


def frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A frame for each timeline segment that shows something, and the pictures: the grid of the vector whose number is the length of its ref."""
    shown = table(spark, d, "events").where("event_type <> 'click' and event_type <> ''").select(F.length("event_type").cast("long").alias("picture")).distinct()
    grids = table(spark, d, "embeddings").select(F.col("vec_id").alias("picture"), grid().alias("luma")).join(shown, "picture", "left_semi")
    return timeline(spark, d).where("ref <> ''").select("item_id", "idx", "start", F.length("ref").cast("long").alias("picture")), grids


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    shots, pictures = frames(spark, d)
    return windows.frame_fingerprint(shots, pictures=pictures)


@query(TIMELINE + ", " + DHASH + FRAMES + "select item_id, signature from y", items=False)
def frame_fingerprint(spark, d):
    return fingerprints(spark, d)


@query(TIMELINE + 'select item_id, idx, start, "end", ref from l', items=False)
def timeline_segments(spark, d):
    return timeline(spark, d).select("item_id", F.col("idx").cast("long").alias("idx"), "start", "end", "ref")


@query(TIMELINE + REFS + "select item_id, signature from x", items=False)
def first_k_signature(spark, d):
    return windows.first_k_signature(timeline(spark, d))


@query("""
with g as (select item_id, count(*) over (partition by media_type, size_bytes, sha256) as n, row_number() over (partition by media_type, size_bytes, sha256 order by path, item_id) as rn from items),
r as (select i.item_id, i.path, i.ext, strftime(mtime, '%Y%m%d') as k, case when review_state = 'review' then 'review' when n > 1 and rn > 1 then 'duplicates' when ext = 'txt' then 'probe_errors' when lang = 'de' then 'by_category/german' else 'by_month/' || strftime(mtime, '%Y-%m') end as route from items i join g using (item_id)),
x as (select *, row_number() over (partition by route || '/' || k || '_' || 'x', ext order by path, item_id) as c from r)
select item_id, route, route || '/' || k || '_x' || case when c > 1 then '_' || lpad(c::varchar, 3, '0') else '' end || '.' || ext as target from x""")
def plan_names(spark, d):
    rows = windows.mark_duplicates(all_items(spark, d)).select("item_id", "path", "ext", "review_state", "duplicate_role", F.when(F.col("ext") == "txt", "no probe").alias("probe_error"), F.when(F.col("lang") == "de", "german").alias("category"), F.date_format("mtime", "yyyyMMdd").alias("date_key"), F.lit("x").alias("slug"))
    return windows.plan_names(rows)


@query("select item_id, filename, (select count(*) from live) as total from live order by mtime desc, item_id desc limit 50 offset 100")
def recent_page(spark, d):
    return search.recent_page(all_items(spark, d), 50, 100).select("item_id", "filename", "total")


@query("select item_id, ((item_id % 2147483647) * 1103515245 + 7) % 2147483647 as shuffle_key from live order by shuffle_key, item_id limit 50")
def seeded_shuffle(spark, d):
    return search.seeded_shuffle(all_items(spark, d), 7, 50).select("item_id", "shuffle_key")


@query("select item_id from items where review_state = 'review' or item_id in (select doc_id from labels where toxic = 1) order by mtime desc, item_id desc limit 100")
def review_queue(spark, d):
    risk = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id"), F.lit("risk").alias("tag"), F.lit("confirmed").alias("state"))
    return gate.review_queue(all_items(spark, d), risk, "risk", 100).select("item_id")


@query("select count(*) as live from live where item_id not in (select doc_id from labels where toxic = 1)")
def tombstone(spark, d):
    ids = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id"))
    return gate.passed(gate.tombstone(all_items(spark, d), ids)).agg(F.count("*").alias("live"))


@query("select item_id from live where sha256 not in (select sha256 from live where root = 'src0')")
def incremental_only(spark, d):
    rows = live_items(spark, d)
    return joins.incremental_only(rows, rows.where("root = 'src0'"), ["sha256"]).select("item_id")


@query("select coalesce(l.doc_id, i.item_id) as item_id, coalesce(l.quality, -1) as quality from items i full join labels l on l.doc_id = i.item_id where coalesce(l.doc_id, i.item_id) in (select item_id from live)")
def merge_keyed(spark, d):
    rows = all_items(spark, d)
    old = rows.select("item_id", F.lit(-1).alias("quality"))
    new = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").cast("int").alias("quality"))
    return readers.merge_keyed(old, new, "item_id", gate.passed(rows))


@query("select 'orders' as source, count(*) as rows from orders union all select 'events', count(*) from events union all select 'pages', count(*) from pages", items=False)
def rowcount_report(spark, d):
    return readers.rowcount_report({n: table(spark, d, n) for n in ("orders", "events", "pages")})


@query("""
with m as (select path as original_path, 'new/' || filename as new_path, item_id as seq from items),
l as (select new_path, original_path from m qualify row_number() over (partition by new_path order by seq desc) = 1),
i as (select item_id, case when item_id % 2 = 0 then 'new/' || filename else path end as p from live)
select i.item_id, coalesce(l.original_path, i.p) as origin, s.size_bytes as manifest_size from i left join l on l.new_path = i.p left join (select path, size_bytes from items qualify row_number() over (partition by path order by item_id desc) = 1) s on s.path = coalesce(l.original_path, i.p)""")
def link_manifest(spark, d):
    rows = all_items(spark, d)
    moves = rows.select(F.col("path").alias("original_path"), F.concat(F.lit("new/"), "filename").alias("new_path"), F.col("item_id").alias("seq"))
    manifest = rows.select(F.col("path").alias("original_path"), F.col("item_id").alias("seq"), F.col("size_bytes").alias("manifest_size"))
    now = rows.select("item_id", "review_state", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("new/"), "filename")).otherwise(F.col("path")).alias("path"))
    return joins.link_manifest(now, moves, manifest).select("item_id", "origin", "manifest_size")


@query("""
with k as (select key, min(item_id) as item_id from (select relative_path as key, item_id from live union all select path, item_id from live union all select replace(relative_path, '/', chr(92)), item_id from live) group by key),
w as (select item_id as label_id, case item_id % 3 when 0 then relative_path when 1 then path else replace(relative_path, '/', chr(92)) end as media_path from items)
select label_id, k.item_id from w join k on k.key = w.media_path""")
def join_by_any_path(spark, d):
    rows = all_items(spark, d)
    i = F.col("item_id")
    wanted = rows.select(i.alias("label_id"), F.when(i % 3 == 0, F.col("relative_path")).when(i % 3 == 1, F.col("path")).otherwise(F.replace("relative_path", F.lit("/"), F.lit("\\"))).alias("media_path"))
    return joins.join_by_any_path(wanted, gate.passed(rows)).select("label_id", "item_id")


@query("with w as (select case item_id % 2 when 0 then filename else path end as wanted from items where item_id % 10 = 0) select item_id from live where relative_path in (select wanted from w) or path in (select wanted from w) or filename in (select wanted from w)")
def lookup_paths(spark, d):
    rows = all_items(spark, d)
    wanted = rows.where("item_id % 10 = 0").select(F.when(F.col("item_id") % 2 == 0, F.col("filename")).otherwise(F.col("path")).alias("wanted"))
    return joins.lookup_paths(gate.passed(rows), wanted).select("item_id")


@query("select item_id from live where root <> 'src3' or item_id % 4 <> 0")
def delete_unseen(spark, d):
    rows = live_items(spark, d)
    return joins.delete_unseen(rows, rows.where("item_id % 4 <> 0"), "src3").select("item_id")


@query("""
with moves as (select 'p' || (o_orderkey)::varchar as dest, 'p' || (o_orderkey // 3)::varchar as source from orders where o_orderkey % 7 <> 0),
t as (select 'p' || o_orderkey::varchar as path, 'p' || o_orderkey::varchar as cur, ['p' || o_orderkey::varchar] as seen, 0 as hops from orders
  union all select t.path, m.source, list_append(t.seen, m.source), t.hops + 1 from t join moves m on m.dest = t.cur where not list_contains(t.seen, m.source) and t.hops < 16)
select path, arg_max(cur, hops) as origin, max(hops) as hops from t group by path""")
def trace_original(spark, d):
    orders = table(spark, d, "orders")
    key = F.col("o_orderkey")
    moves = orders.where("o_orderkey % 7 <> 0").select(F.concat(F.lit("p"), key.cast("string")).alias("dest"), F.concat(F.lit("p"), F.expr("o_orderkey div 3").cast("string")).alias("source"), key.alias("seq"))
    return joins.trace_original(orders.select(F.concat(F.lit("p"), key.cast("string")).alias("path")), moves)


@query("with m as (select substr(sha256, 1, 8) as h, min(path) as origin from items group by 1) select item_id, origin from live join m on m.h = regexp_extract(filename, '_([0-9a-f]{8})\\.', 1) where item_id % 3 = 0")
def trace_by_hash8(spark, d):
    rows = all_items(spark, d)
    manifest = rows.select(vectors.hash8(F.col("sha256")).alias("hash8"), F.col("path").alias("original_path"))
    return joins.trace_by_hash8(gate.passed(rows).withColumn("hash8", names.hash8_from_name(F.col("filename"))), manifest)


@query("select item_id, case when item_id % 3 <> 0 then filename else coalesce(case when item_id % 2 = 0 then 'traced_' || item_id::varchar end, filename) end as original_name from live")
def prefer_original_name(spark, d):
    rows = all_items(spark, d).select("item_id", "review_state", F.col("filename").alias("original_name"))
    traced = rows.where("item_id % 2 = 0").select("item_id", F.concat(F.lit("traced_"), F.col("item_id").cast("string")).alias("traced_name"))
    return joins.prefer_original_name(rows, traced, names.is_normalized_name).drop("review_state")


@query("""
with l as (select path as source, root || '/' || (item_id % 50)::varchar as dest, item_id as seq, case item_id % 3 when 0 then 'applied' when 1 then 'planned' else 'duplicate' end as kind, item_id % 3 as p from items)
select source, dest, kind from l qualify row_number() over (partition by dest order by p, seq, source) = 1""")
def movement_log(spark, d):
    rows = all_items(spark, d).select(F.col("path").alias("source"), F.concat_ws("/", "root", (F.col("item_id") % 50).cast("string")).alias("dest"), F.col("item_id").alias("seq"))
    return joins.movement_log(*(rows.where(f"seq % 3 = {i}") for i in range(3)))


@query("select case o_orderstatus when 'F' then 'moved' when 'O' then 'planned' else 'duplicate' end as status, case when o_orderstatus = 'O' then '' else lower(o_orderpriority) end as top_folder, count(*) as rows from orders group by 1, 2", items=False)
def moves_rollup(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "moved").when(F.col("o_orderstatus") == "O", "planned").otherwise("duplicate")
    return reports.moves_rollup(table(spark, d, "orders").select(status.alias("status"), F.concat_ws("/", F.lower("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("dest")))


@query("""
with g as (select item_id, count(*) over w > 1 and row_number() over (partition by media_type, size_bytes, sha256 order by path, item_id) > 1 as dup from items window w as (partition by media_type, size_bytes, sha256))
select count(*) as items, count(*) filter (where media_type = 'video') as videos, count(*) filter (where media_type = 'photo') as photos, count(*) filter (where review_state = 'normal' and not dup) as kept, count(*) filter (where review_state = 'normal' and dup) as moved, count(*) filter (where review_state = 'review') as reviewed, count(*) filter (where contains(filename, 'clip')) as flagged, count(*) filter (where dup) as duplicates from items join g using (item_id)""")
def scan_summary(spark, d):
    rows = windows.mark_duplicates(all_items(spark, d)).withColumn("duplicate", F.col("duplicate_role") == "candidate")
    action = F.when(F.col("review_state") == "review", "review").when(F.col("duplicate"), "move").otherwise("keep")
    return reports.scan_summary(rows.withColumn("action", action).withColumn("flags", names.flags_for(F.col("filename"), F.lit(None).cast("string"), "clip", "^$")))


@query("""
with t as (select item_id, count(*) as tags, string_agg(tag || ':' || state, ',' order by category, tag) as tag_list from tags group by 1),
s as (select conv_id as item_id, count(*) as segments, string_agg(role, ',' order by turn, role) as labels, string_agg(text, chr(10) order by turn, text) as text from conversations group by 1),
r as (select user_id as item_id, event_type || ':' || event_id::varchar as operation, row_number() over (partition by user_id order by ts desc, event_type || ':' || event_id::varchar desc) as rn from events),
o as (select item_id, count(*) as operations, string_agg(operation, ',' order by rn) as log from r where rn <= 30 group by 1)
select item_id, filename, coalesce(tags, 0) as tags, tag_list, coalesce(segments, 0) as segments, labels, coalesce(operations, 0) as operations, log, sha256(s.text) as transcript from live left join t using (item_id) left join s using (item_id) left join o using (item_id)""")
def item_detail(spark, d):
    segments = table(spark, d, "conversations").select(F.col("conv_id").alias("item_id"), (F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 4).alias("end"), F.col("role").alias("label"))
    audit = table(spark, d, "events").select(F.col("user_id").alias("item_id"), F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("operation"), F.col("ts").alias("created_at"))
    found = joins.item_detail(live_items(spark, d).select("item_id", "filename", "review_state"), all_tags(spark, d), segments, audit, transcripts(spark, d))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c)
    each = lambda c, f: F.array_join(F.transform(c, f), ",")
    lists = each("tags", lambda t: F.concat_ws(":", t["tag"], t["state"])).alias("tag_list"), each("segments", lambda s: s["label"]).alias("labels"), each("operations", lambda o: o["operation"]).alias("log")
    return found.select("item_id", "filename", n("tags"), n("segments"), n("operations"), *lists, F.sha2("transcript", 256).alias("transcript"))


@query("select item_id, sha256, substr(sha256, 1, 8) as hash8, sha256(text || strlen(text)::varchar) as partial_hash from live")
def content_hashes(spark, d):
    body = F.col("text").cast("binary")
    return live_items(spark, d).select("item_id", vectors.full_hash(body).alias("sha256"), vectors.hash8(vectors.full_hash(body)).alias("hash8"), vectors.partial_hash(body).alias("partial_hash"))


def dhashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", vectors.dhash_bits(grid()).alias("dhash"))


def grid() -> Column:
    """A vector's places as a 9 x 8 grid, from the first again after the last."""
    return F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.get("embedding", i % F.size("embedding")))


@query("""
with v as (select vec_id, embedding, vec_id % 80 as dim from embeddings),
u as (select vec_id, 4 * len(embedding) as n_bytes, embedding, unnest(range(1, case when dim <= len(embedding) then dim else 0 end + 1)) as place from v)
select vec_id, n_bytes::bigint as n_bytes, place::bigint as place, embedding[place]::double as x from u""", items=False)
def packed_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", vectors.pack_vector("embedding").alias("blob"))
    places = rows.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), F.posexplode(vectors.unpack_vector("blob", F.col("vec_id") % 80)).alias("i", "x"))
    return places.select("vec_id", "n_bytes", (F.col("i") + 1).cast("long").alias("place"), F.col("x").cast("double").alias("x"))


@query("with " + DHASH + " select item_id as vec_id, signature as dhash from p", items=False)
def dhash(spark, d):
    return dhashes(spark, d)


def weighed(vector: Column) -> Column:
    """The sum of a vector's places, each times its number from 1 on: one column that depends on every place."""
    return F.aggregate(F.transform(vector, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)


@query("with b as (select item_id, unnest(range(0, 64)) as i, sha256 from live) select item_id, sum(case when (('0x' || substr(sha256, (i // 4 + 1)::int, 1))::int // (8 // (1 << (i % 4)::int))) % 2 = 1 then 0.125::double else -0.125::double end * (i + 1)) as weighed from b where sha256 is not null group by item_id")
def hash_bits_vector(spark, d):
    rows = live_items(spark, d).where("sha256 is not null")
    return rows.select("item_id", weighed(vectors.hash_bits_vector(F.substring("sha256", 1, 16))).alias("weighed"))


@query(r"""
with w as (select item_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_-]+)', 1)) as w from live),
t as (select item_id, md5(w) as m from (select item_id, substr(regexp_replace(w, '^[_-]+|[_-]+$', '', 'g'), 1, 48) as w from w) where length(w) >= 2),
s as (select item_id, (('0x' || substr(m, 1, 8))::bigint % 128)::int as b, sum(case when ('0x' || substr(m, 9, 2))::int % 2 = 1 then 1.0 else -1.0 end)::double as s from t group by 1, 2),
n as (select item_id, sqrt(sum(s * s)) as norm from s group by item_id)
select item_id, b, round(s / norm, 6) as x from s join n using (item_id) where s <> 0""")
def hashed_text_vector(spark, d):
    v = vectors.hashed_texts(live_items(spark, d).select("item_id", "text")).select("item_id", F.posexplode("vector").alias("b", "x"))
    return v.where("x <> 0").withColumn("x", F.round("x", 6))


@query("""
with q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 100 = 0), b as (select vec_id as item_id, embedding::double[] as v from embeddings where vec_id in (select item_id from live)),
s as (select query_id, item_id, list_dot_product(q.v, b.v) * 1.0 as score from q, b where query_id <> item_id)
select query_id, item_id, round(score, 5) as score from s qualify row_number() over (partition by query_id order by score desc, item_id desc) <= 5""")
def cosine_topk(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.lit("image").alias("kind"), F.lit("m").alias("model"), F.col("embedding").cast("array<double>").alias("vector"))
    queries = rows.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    return vectors.cosine_topk(all_items(spark, d), rows, queries, 5).select("query_id", "item_id", F.round("score", 5).alias("score"))


@query("""
with b as (select vec_id as item_id, embedding::double[] as v from embeddings where vec_id in (select item_id from live)), q as (select embedding::double[] as v from embeddings where vec_id = 7),
s as (select b.item_id, list_dot_product(b.v, q.v) * 1.15 + 0.28 * (contains(lower(text), 'the')::int + contains(lower(text), 'der ')::int) / 2.0 + case when b.item_id in (select item_id from tags where tag = 'hd') then 0.08 else 0 end as score from b, q join live on true where live.item_id = b.item_id and not contains(lower(text), 'apache'))
select item_id, round(score, 5) as score from s where score >= 0.16 order by score desc, item_id desc limit 20""")
def semantic_search(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.lit("image").alias("kind"), F.lit("m").alias("model"), F.col("embedding").cast("array<double>").alias("vector"))
    items = all_items(spark, d)
    found = vectors.semantic_search(items, rows, rows.where("item_id = 7"), items.select("item_id", "text"), 20, prefer=("the", "der "), exclude=("apache",), tag="hd", tags=all_tags(spark, d))
    return found.select("item_id", F.round("score", 5).alias("score"))


@query(r"""
with src as (
  select item_id, 'name' as kind, filename as text from live where item_id % 2 = 1 union all select item_id, 'text', text from live
  union all select item_id, 'tag', string_agg(tag, ',' order by tag) from tags where state <> 'rejected' group by item_id
  union all select conv_id, 'transcript', string_agg(text, chr(10) order by turn, text) from conversations where conv_id in (select item_id from live) group by conv_id),
w as (select item_id, kind, sha256(text) as text_hash, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_-]+)', 1)) as w from src where length(text) > 0),
m as (select item_id, kind, text_hash, md5(w) as m from (select item_id, kind, text_hash, substr(regexp_replace(w, '^[_-]+|[_-]+$', '', 'g'), 1, 48) as w from w) where length(w) >= 2),
s as (select item_id, kind, text_hash, (('0x' || substr(m, 1, 8))::bigint % 128)::int as b, sum(case when ('0x' || substr(m, 9, 2))::int % 2 = 1 then 1.0 else -1.0 end)::double as s from m group by all)
select item_id, kind, text_hash, count(*) filter (where s <> 0) as places, round(case when sum(s * s) > 0 then sum(s * (b + 1)) / sqrt(sum(s * s)) else 0.0::double end, 5) as weighed from s group by all""")
def vector_index(spark, d):
    items = all_items(spark, d)
    rows, spoken = items.drop("review_state"), transcripts(spark, d)  # vector_index takes the texts of items that passed
    kinds = {"name": rows.select("item_id", F.col("filename").alias("text")), "text": rows.select("item_id", "text"), "tag": reports.tags_concat(all_tags(spark, d)).withColumnRenamed("tags", "text"), "transcript": spoken}
    parts = reduce(DataFrame.union, (df.select("item_id", F.lit(kind).alias("kind"), "text") for kind, df in kinds.items()))
    done = parts.where("kind = 'name' and item_id % 2 = 0").select("item_id", "kind", F.lit("md5-128").alias("model"), F.sha2("text", 256).alias("text_hash"))
    found = vectors.vector_index(items, parts, done, "md5-128")
    return found.select("item_id", "kind", "text_hash", F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("places"), F.round(weighed(F.col("vector")), 5).alias("weighed"))


@query("select case when vec_id % 10 = 0 or l.item_id is null then 'failed' when vec_id % 4 = 0 then 'skipped' else 'imported' end as outcome, count(*) as rows from embeddings e left join live l on l.item_id = e.vec_id group by 1")
def import_vectors(spark, d):
    return vector_imports(spark, d)[1]


@query("""
with e as (select vec_id as item_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings where vec_id % 10 <> 0 and vec_id % 4 <> 0 and vec_id in (select item_id from live))
select item_id, count(*) as places, round(case when sum(x * x) > 0 then sum(x * i) / sqrt(sum(x * x)) else 0.0::double end, 4) as weighed from e group by item_id""")
def imported_vectors(spark, d):
    new = vector_imports(spark, d)[0]
    return new.select("item_id", F.size("vector").cast("long").alias("places"), F.round(weighed(F.col("vector")), 4).alias("weighed"))


def vector_imports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("media_path"), F.lit("m").alias("model"), F.when(F.col("vec_id") % 10 != 0, F.col("embedding")).otherwise(F.array().cast("array<float>")).alias("embedding"))
    items = all_items(spark, d).select("item_id", "review_state", F.concat(F.lit("p"), F.col("item_id").cast("string")).alias("path"))
    return vectors.import_vectors(items, rows, items.where("item_id % 4 = 0").select("item_id", F.lit("m").alias("model")))


@query("select time_bucket(interval 10 minutes, ts) as start, count(*) filter (where event_type <> 'error') as processed, count(*) filter (where event_type = 'error') as failed from events group by 1", items=False)
def ingest_rate(spark, d):
    events = table(spark, d, "events").select("ts", F.when(F.col("event_type") == "error", "failed").otherwise("processed").alias("outcome"))
    return ingest.ingest_rate(events)


SIGNATURES = """
with h as (select root, size_bytes, mtime, item_id, ('0x' || substr(md5(concat_ws('|', coalesce(path, ''), coalesce(size_bytes::varchar, ''), coalesce(epoch(mtime)::bigint::varchar, ''))), 1, 15))::bigint as bits from live)
"""


@query(SIGNATURES + "select root, count(*) as files, coalesce(sum(size_bytes), 0)::bigint as bytes, max(mtime) as latest, coalesce(sum(bits), 0)::varchar as digest from h group by root")
def watch_signature(spark, d):
    return ingest.watch_signature(live_items(spark, d), "root")


@query(SIGNATURES + """,
n as (select root, count(*) as files, sum(size_bytes)::bigint as bytes, sum(bits)::varchar as digest from h where root <> 'src1' group by root),
o as (select root, count(*) as files, sum(size_bytes)::bigint as bytes, sum(bits)::varchar as digest from h where root <> 'src2' and (root <> 'src0' or item_id % 7 <> 0) group by root)
select coalesce(n.root, o.root) as root, case when o.root is null then 'new' when n.root is null then 'gone' else 'changed' end as change, coalesce(n.files, o.files) as files, coalesce(n.bytes, o.bytes) as bytes, coalesce(n.digest, o.digest) as digest
from n full join o on n.root = o.root where n.digest is distinct from o.digest""")
def watch_changes(spark, d):
    """Two scans of the items: the first without a root and some files of another, the second without a third root."""
    rows = live_items(spark, d)
    first = ingest.watch_signature(rows.where("root <> 'src2' and (root <> 'src0' or item_id % 7 <> 0)"), "root")
    return ingest.watch_changes(ingest.watch_signature(rows.where("root <> 'src1'"), "root"), first).drop("latest")
