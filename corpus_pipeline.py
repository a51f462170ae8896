"""The corpus pipeline: documents through language ID, near duplicates, repeated strings, benchmark passages and mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import decontam, langid, mixing, ngram_join, scratch, suffix_dedup

LEAST_SCORE = 0.4
SMALL_IDS = 500_000  # ids up to which they are broadcast (8 MB); beyond, both sides shuffle


def aside(docs: DataFrame, names: tuple[str, ...]) -> dict[str, str]:
    """Other names for the columns that an operator would replace by its results."""
    return {c: f"_kept_{c}" for c in docs.columns if c.lower() in names}


def back(rows: DataFrame, docs: DataFrame, others: dict[str, str]) -> DataFrame:
    """The columns of docs, and nothing else."""
    return rows.select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letter, or no language with LEAST_SCORE of the text.

    Null and empty texts have none and go; rows with null lang are judged like others; repeated rows are judged alike.
    Ties between languages go to the first by name; columns stay as they are, results of the operator are not kept.
    """
    others = aside(docs, langid.NAMES)
    found = langid.predict(docs.withColumnsRenamed(others), langid.fit(docs), mixture=False)
    return back(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs, others)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of linked documents, once; documents without an id stay.

    Null and empty texts are linked with nothing and stay. Of rows that share a doc_id one stays: the one whose text has the
    smallest SHA-256, a null text after all others; of equal texts the row that comes first written as JSON.
    """
    groups = ngram_join.jaccard_components(docs.select("doc_id", "text"))
    others = scratch.save(groups.where("doc_id <> component_id").select("doc_id").distinct(), "others")
    few = others.count() <= SMALL_IDS
    kept = docs.join(F.broadcast(others) if few else others, "doc_id", "left_anti").select(*docs.columns)
    repeated = scratch.save(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    order = F.struct(F.col("text").isNull(), F.sha2("text", 256), F.to_json(F.struct(*docs.columns)))
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings that an earlier document holds, in whole characters; documents of which no word is left go.

    Documents that lose nothing stay as they are, also those with null or empty text; n_chars, where there is one, follows
    the text.
    """
    others = aside(docs, suffix_dedup.NAMES)
    cut = suffix_dedup.remove_repeats(docs.withColumnsRenamed(others), characters=True)
    rest = cut.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(rest, docs, others)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; null and empty texts hold none and stay; so does all if there is no item."""
    others = aside(docs, decontam.NAMES)
    checked = decontam.decontaminate(docs.withColumnsRenamed(others), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return back(checked.where("not contaminated"), docs, others)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds how many words the mix takes from each document; columns of these names are replaced, no row goes."""
    return mixing.mix_sources(docs).select(*[c for c in docs.columns if c.lower() not in mixing.NAMES], *mixing.NAMES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_passages),
    ("source_mixing", mixture),
]

ORACLE_SQL = None  # mixture inference, suffix arrays and random draws aren't SQL; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = scratch.save(docs, name)
    return docs
