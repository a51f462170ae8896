"""One query for each operation, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_join

    return ngram_join.jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import media

    return media.media_report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.union(added)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.score(docs.select("doc_id", "text"), labels, quality.learnable(4, 2))
    return found.select("doc_id", (~quality.learnable(4, 2)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality, toxicity

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs.select("doc_id", "text"), labels, quality.learnable(3, 1))
    return found.select("doc_id", (~quality.learnable(3, 1)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", *decontam.NAMES)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs, langid.learnable(3, 1))
    return langid.predict(docs, model, mixture=False).select("doc_id", (~langid.learnable(3, 1)).alias("held_out"), "lang_pred", "score")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", *mixing.NAMES)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import hard_negatives

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import url_filter

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(pages, rules).select("page_id", *url_filter.NAMES)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fill_middle

    stored = fill_middle.store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return fill_middle.digests(fill_middle.fill_middle(stored)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_media_columns": op2_media_columns,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_language_id": op9_language_id,
    "op10_source_mixing": op10_source_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filter": op12_url_filter,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op7_benchmark_decontamination": decontam.ORACLE,
    "op11_hard_negatives": """
with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score from r a join r b on a.vec_id % 100 = 0 and len(a.v) = len(b.v)),
p as (select anchor_id, id, score from s where same and id <> anchor_id qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, p.score as positive_score, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.anchor_id, p.id order by s.score desc, s.id)::int as rank
  from p join s using (anchor_id) where not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 10""",
    "op12_url_filter": r"""
with rules(rule_host, rule_path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r as (select page_id, case when strpos(coalesce(url, ''), '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
f as (select page_id, max_by(struct_pack(rule := rule_host || rule_path, verdict := verdict), (len(string_split(rule_host, '.')), length(rule_path), verdict)) as best
  from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by page_id)
select p.page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from p left join f using (page_id)""",
    "op13_fill_in_middle": r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as x, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units from documents),
h as (select *, len(units) as n, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2, ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, coalesce(array_to_string(units[1:a], ''), '') as prefix, coalesce(array_to_string(units[a + 1:b], ''), '') as middle, coalesce(array_to_string(units[b + 1:], ''), '') as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256 from p""",
}
