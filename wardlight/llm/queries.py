"""The operators applied to the whole test tables, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import (
    bpe,
    exact_dedup,
    language_id,
    lexical_search,
    license_scan,
    line_dedup,
    packing,
    periodic_runs,
    quality,
    simhash,
    suffix_dedup,
    token_count,
    url_filter,
)
from wardlight.session import written
from wardlight.sources.driver_tables import driver_table

# The rules of the url query: host and path, and whether they allow.
URL_RULES = [
    ("com/", True), ("example.com/en/", False), ("www.example.com/en/", True), ("net/es/", False), ("net/fr/", False),
]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return driver_table(spark, folder, "documents")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each document and how many repeated windows take away, with the kept text's hash."""
    return line_dedup.line_cuts(documents(spark, folder)).select(
        "doc_id", "cut.n_lines", "cut.n_removed", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.schema("page_id bigint, url string").parquet(f"{folder.rstrip('/')}/pages.parquet")
    return url_filter.url_filter(pages, URL_RULES)


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.suffix_dedup(documents(spark, folder)))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(packing.pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json")))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_groups(documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return token_count.token_count(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, folder))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    out = language_id.held_out()
    found = language_id.language(F.col("text"), language_id.fit(docs, ~out))
    return docs.select("doc_id", out.alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score", "found.accepted")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    counts = quality.statistics(docs)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    sample = written(quality.statistics(quality.draw(docs)), "counts")
    rules = quality.ordered(sample, quality.text_rules())
    return counts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        F.when(base, F.lit(False)).otherwise(quality.first_failed(rules).isNull()).alias("kept"),
    )


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.digests(license_scan.license_scan(documents(spark, folder)))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    items = spark.read.schema("item_id bigint, text string").parquet(f"{folder.rstrip('/')}/benchmark.parquet")
    return lexical_search.lexical_search(documents(spark, folder), items, 50)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    planted = periodic_runs.with_planted_periods(documents(spark, folder))
    return periodic_runs.digests(periodic_runs.periodic_runs(planted))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_url_filter, op3_suffix_dedup, op4_bpe, op5_packing, op6_simhash, op7_token_count, op8_exact_dedup,
        op9_language_id, op10_quality, op11_license_scan, op12_lexical_search, op13_periodic_runs,
    )
}
