"""A training-corpus pipeline: each stage applies one operator of parlance.llm to what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents``; the last adds the
rate of each document and the number of copies that it stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontaminate, exact_dedup, hashed_text, jaccard_join, mixing, quality
from parlance.llm.common import stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather poor than sound, P(grade ≥ 1) < 0.5, go."""
    ratings = quality.grades_of(table(spark, sf_dir, "labels"))
    model = quality.train(docs, ratings, learn_from=~hashed_text.held_out(F.col("doc_id")))
    return quality.drop_poor(docs, model)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 90 % of their 3-word shingles, the one with the smallest id stays."""
    return jaccard_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in 20 or more lies in a benchmark window go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that bring the languages' token shares to the targets; documents with no copy go."""
    covered = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(covered, "doc_id")
    return mixing.mix(docs, labelled).where("copies > 0")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: SQL can express neither the fitted classifier nor the fitted rates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
