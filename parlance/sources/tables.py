"""Driver tables and the views that map them onto the opinion-corpus model.

The input is a folder of parquet tables (``documents``, ``embeddings``,
``events``, ``labels``, ``conversations``, ...).  The model's own tables are
views over them (see FIXTURES.md §2); each view has a DataFrame form (used by
the library) and an ANSI-SQL form (used by the DuckDB oracle), kept side by
side so they cannot drift apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the fixture mapping (FIXTURES.md §2).
MAIN_CITY = "es"                      # plays the one city the corpus is about
EXCLUDED_ACCOUNTS = ("src0", "src3")  # play the uninteresting accounts
EPOCH_DATE = "2021-01-29"             # first complete day of the corpus
DAYS_SPAN = 60                        # posts spread over 60 days
NOISE_EVERY = 7                       # vectors_noise: vec_id % 7 = 0 is noise


# A session setting for inputs of a few files: scans are dealt out over so many partitions by their first
# column.  Unset (the default, and the right choice for tables of many files), a scan stays as it is.
SCAN_PARTITIONS = "spark.parlance.scanPartitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(parts), df.columns[0]) if parts else df


def _created_at(doc_id: Column) -> Column:
    secs = (F.unix_timestamp(F.lit(EPOCH_DATE + " 00:00:00"))
            + (doc_id % DAYS_SPAN) * 86400 + (doc_id % 1440) * 60)
    return F.timestamp_seconds(secs)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` seen as posts: id, full_text, screen_name, city_tag, lang, created_at."""
    return posts_from(table(spark, sf_dir, "documents"))


def posts_from(d: DataFrame) -> DataFrame:
    """The posts mapping of a documents frame (batch or stream)."""
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("full_text"),
        F.col("source").alias("screen_name"),
        F.col("lang").alias("city_tag"),
        F.col("lang"),
        _created_at(F.col("doc_id")).alias("created_at"),
    )


POSTS_SQL = f"""SELECT doc_id AS id, text AS full_text, source AS screen_name, lang AS city_tag, lang,
  TIMESTAMP '{EPOCH_DATE} 00:00:00' + to_seconds((doc_id % {DAYS_SPAN}) * 86400 + (doc_id % 1440) * 60) AS created_at
FROM documents"""


def vectors(spark: SparkSession, sf_dir: str, noise: bool = False) -> DataFrame:
    """``embeddings`` as (doc_id, features ARRAY<DOUBLE>, label)."""
    e = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("int")
    if noise:
        label = F.when(F.col("vec_id") % NOISE_EVERY == 0, F.lit(-1)).otherwise(label)
    return e.select(F.col("vec_id").alias("doc_id"),
                    F.col("embedding").cast(T.ArrayType(T.DoubleType())).alias("features"),
                    label.alias("label"))


def vectors_sql(noise: bool = False) -> str:
    label = (f"CASE WHEN vec_id % {NOISE_EVERY} = 0 THEN -1 ELSE CAST(label AS INTEGER) END"
             if noise else "CAST(label AS INTEGER)")
    return (f"SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS features, {label} AS label "
            f"FROM embeddings")


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as clustering result rows (the flat 17-column result CSV)."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        F.lit("daily").alias("frequency"),
        F.date_format("ts", "yyyy-MM-dd").alias("tag"),
        F.concat(F.lit("emb"), (F.col("user_id") % 4).cast("string")).alias("embedder"),
        F.col("event_type").alias("algorithm"),
        (F.col("value") / 1000).alias("time"),
        (eid % 11 != 0).alias("success"),
        (eid % 6 + 2).cast("long").alias("n_clusters"),
        (eid % 3 == 0).alias("has_outliers"),
        (eid % 50 + 10).cast("long").alias("tweets"),
        (eid % 40 + 10).cast("long").alias("valid_tweets"),
        (eid % 10).cast("long").alias("outliers"),
        ((eid % 100) / 100).alias("noise_percentage"),
        ((eid % 50 + 10) / (eid % 6 + 2)).alias("avg_cluster_size"),
        (eid % 4 + 1).cast("long").alias("min_cluster_size"),
        (eid % 9 + 5).cast("long").alias("max_cluster_size"),
        F.when(eid % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("value") / 400).alias("sil_score"),
        (F.col("value") / 100).alias("db_score"),
        F.col("value").alias("ch_score"),
    )


RESULT_ROWS_SQL = """SELECT 'daily' AS frequency, strftime(ts, '%Y-%m-%d') AS tag,
  'emb' || CAST(user_id % 4 AS VARCHAR) AS embedder, event_type AS algorithm,
  value / 1000 AS time, (event_id % 11 <> 0) AS success, CAST(event_id % 6 + 2 AS BIGINT) AS n_clusters, (event_id % 3 = 0) AS has_outliers,
  CAST(event_id % 50 + 10 AS BIGINT) AS tweets, CAST(event_id % 40 + 10 AS BIGINT) AS valid_tweets,
  CAST(event_id % 10 AS BIGINT) AS outliers, (event_id % 100) / 100 AS noise_percentage,
  (event_id % 50 + 10) / (event_id % 6 + 2) AS avg_cluster_size,
  CAST(event_id % 4 + 1 AS BIGINT) AS min_cluster_size, CAST(event_id % 9 + 5 AS BIGINT) AS max_cluster_size,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 400 END AS sil_score,
  value / 100 AS db_score, value AS ch_score
FROM events"""


def day_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as per-day entity occurrences: (tag, entity_type, item)."""
    return day_sets_from(table(spark, sf_dir, "events"))


def day_sets_from(e: DataFrame) -> DataFrame:
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("tag"),
                    F.col("event_type").alias("entity_type"),
                    F.col("user_id").cast("string").alias("item"))


DAY_SETS_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS tag, event_type AS entity_type,
  CAST(user_id AS VARCHAR) AS item FROM events"""


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` ⋈ ``labels``: (doc_id, text, positive)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("positive"))


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Register every driver table and model view as a temp view (SQL users)."""
    for name in TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    posts(spark, sf_dir).createOrReplaceTempView("posts")
    vectors(spark, sf_dir).createOrReplaceTempView("vectors")
    vectors(spark, sf_dir, noise=True).createOrReplaceTempView("vectors_noise")
    result_rows(spark, sf_dir).createOrReplaceTempView("result_rows")
