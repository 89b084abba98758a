"""The registered queries of this subpackage: thin projections of the operators' outputs."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, decontaminate, exact_dedup, hashed_text, html_text, jaccard_join, licenses, max_sketch, mixing, packing, quality,
               substring_dedup, token_counts, toxicity)
from .common import table


def quality_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> quality.Model | None:
    """Fitted on the rated documents that are not held out."""
    return quality.train(docs, quality.grades_of(table(spark, sf_dir, "labels")), learn_from=~hashed_text.held_out(F.col("doc_id")))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of the mixing: the documents that ``labels`` covers, by language."""
    covered = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(covered, "doc_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(docs, spark, sf_dir), keep_text=False)
    return scored.select("doc_id", hashed_text.held_out(F.col("doc_id")).alias("held_out"), "score", "expected_grade", "tail", "keep")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, keep_html=False).select("page_id", "url", "text", "n_chars")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mix(docs, languages(spark, sf_dir), keep_text=False)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                             table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_toxicity": op2_toxicity,
    "op3_html_extraction": op3_html_extraction,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_alignment": op13_token_alignment,
}
ORACLES: dict[str, str] = {
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op7_ngram_jaccard_join": jaccard_join.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
    "op12_ranked_search": max_sketch.ORACLE,
}
