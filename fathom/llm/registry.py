"""Queries of the training-data operators, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, licenses, lines, mixing, neighbours, packing, quality, secrets, simhash, urls
from .common import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    """Where the public tokenizer's file lies; never copied, the executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = urls.filter_captures(urls.captures_of(pages), urls.derived_lists(pages))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return judged.select("page_id", "url", text("fetched_at"), "n_active", "list", "action", "kind", "pattern", text("valid_from"), "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer(), with_ids=False)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == F.lit(secrets.KINDS.index(k)))).cast("long").alias(f"n_{k}")
    digest = F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), digest, secrets.joined(F.concat("base", "found")).alias("spans"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.verdicts(quality.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_union("base", F.transform("matches", lambda m: m["label"])))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        "score",
    )


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("lines").cast("long").alias("n_dropped"), F.array_join(F.col("lines").cast("array<string>"), ",").alias("dropped"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_neighbours": op2_neighbours,
    "op3_html": op3_html,
    "op4_urls": op4_urls,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_licenses": op9_licenses,
    "op10_lines": op10_lines,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op4_urls": urls.ORACLE, "op8_quality": quality.ORACLE, "op9_licenses": licenses.oracle()}
