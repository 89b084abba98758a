"""Result-table reports: D2–D11, D20, C3, C5, C7, F8–F11, B7–B11, B16.

Every metric of a report comes from ONE ``groupBy(algorithm, embedder).agg``
(conditional aggregates replace the per-metric frames and their outer
joins), so a report is one shuffle of partial aggregates, however many
result rows there are.  Missing scores are NULL, never NaN (Spark's ``avg``
would not skip NaN).
"""

from __future__ import annotations

import re
from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import check_frequency

KEYS = ["algorithm", "embedder"]

# Short display names of the embedders (fixed values; "(50-d)" variants follow a rule).
EMBEDDER_SHORT_NAMES = {
    "emb0": "Hash",
    "emb1": "Word2Vec",
    "emb2": "Subword",
    "emb3": "TF-IDF",
}


def exact_avg(c) -> Column:
    """Mean whose sum is taken in decimals of 12 places: it does not depend on the order of the rows, so that
    half-even rounding sees the same value on every run."""
    c = F.col(c) if isinstance(c, str) else c
    return F.try_divide(F.sum(c.cast("decimal(28,12)")).cast("double"), F.count(c))


def exact_averages_sql(sql: str) -> str:
    """The SQL twin of ``exact_avg``, for every ``avg(...)`` of a statement."""
    return re.sub(r"\bavg\(((?:[^()]|\([^()]*\))*)\)", r"(CAST(sum(CAST(\1 AS DECIMAL(28,12))) AS DOUBLE) / count(\1))", sql)


def np_round(c, places: int):
    """Round like NumPy / pandas ``.round(n)``: scale, round half to even, unscale."""
    c = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** places)
    return F.rint(c * scale) / scale


def np_round_sql(e: str, places: int) -> str:
    scale = 10 ** places
    return f"(round_even(({e}) * {scale}, 0) / {scale})"


def short_names(spark: SparkSession) -> DataFrame:
    """C5 dimension: embedder → short name, with the reduced "(50-d)" variants."""
    rows = []
    for name, short in EMBEDDER_SHORT_NAMES.items():
        rows.append((name, short))
        rows.append((f"{name} (50-d)", f"{short} (50-d)"))
    return spark.createDataFrame(rows, "embedder string, model string")


def with_short_names(df: DataFrame) -> DataFrame:
    """Broadcast lookup; the dimension is the embedder registry (bounded, 2 rows per embedder)."""
    dim = F.broadcast(short_names(df.sparkSession))
    return df.join(dim, "embedder", "left").withColumn("model", F.coalesce("model", "embedder"))


def of_frequency(results: DataFrame, frequency: str) -> DataFrame:
    """Rows of one frequency; unknown frequencies are rejected."""
    return results.where(F.col("frequency") == check_frequency(frequency))


def exclude(results: DataFrame, algorithm: str | None = None, embedder_substring: str | None = None) -> DataFrame:
    """Drop one algorithm and the embedders whose name contains a substring."""
    out = results
    if algorithm is not None:
        out = out.where(F.col("algorithm") != algorithm)
    if embedder_substring is not None:
        out = out.where(~F.col("embedder").contains(embedder_substring))
    return out


def _valid(c: str) -> Column:
    """Metric value on rows where it and the silhouette are present (D3–D5 exclusion)."""
    return F.when(F.col(c).isNotNull() & F.col("sil_score").isNotNull(), F.col(c))


def metric_aggregates() -> dict[str, Column]:
    return {
        "valid_entries": F.count("sil_score"),                                    # D2
        "n_clusters": exact_avg(_valid("n_clusters")),                                # D3
        "noise_percentage": exact_avg(_valid("noise_percentage") * 100.0),            # D4
        "avg_cluster_size": exact_avg(_valid("avg_cluster_size")),                    # D5
        "sil_score": exact_avg("sil_score"),                                          # D6
        "db_score": exact_avg("db_score"),                                            # D7
        "ch_score": exact_avg("ch_score"),                                            # D8
        "n_valid_rows": F.count(_valid("n_clusters")),
    }


def group_metrics(results: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    aggs = metric_aggregates()
    names = list(names or aggs)
    return results.groupBy(*KEYS).agg(*[aggs[n].alias(n) for n in names])


def average_metric(results: DataFrame, frequency: str, metric: str) -> DataFrame:
    """One metric per (algorithm, embedder), sorted descending.

    D3–D5 drop groups without any valid row (the original filters rows before grouping)."""
    g = group_metrics(of_frequency(results, frequency), [metric, "n_valid_rows"])
    if metric in ("n_clusters", "noise_percentage", "avg_cluster_size"):
        g = g.where(F.col("n_valid_rows") > 0)
    return g.drop("n_valid_rows").orderBy(F.desc_nulls_last(metric), *KEYS)


def with_global(g: DataFrame, fn, col: str, name: str) -> DataFrame:
    """Attach an aggregate over all rows of a *grouped* report frame.

    A report frame has one row per (algorithm, embedder) — bounded by the
    algorithm and embedder registries, not by the number of result rows — so
    a window without partition keys is a small single-partition step here."""
    return g.withColumn(name, fn(col).over(Window.partitionBy()))


def consolidated(results: DataFrame, frequency: str) -> DataFrame:
    """Mean silhouette, valid entries, weighted = sil·valid / max(valid); best first."""
    g = group_metrics(of_frequency(results, frequency), ["sil_score", "valid_entries"])
    g = with_global(g, F.max, "valid_entries", "_max_valid")
    g = g.withColumn("weighted_score", F.try_divide(F.col("sil_score") * F.col("valid_entries"), F.col("_max_valid")))
    return g.drop("_max_valid").orderBy(F.desc_nulls_last("weighted_score"), F.desc_nulls_last("sil_score"), *KEYS)


def three_averages(results: DataFrame, frequency: str, weighted: bool = False, places: int = 3) -> DataFrame:
    """D10 / D10w: silhouette, Davies–Bouldin, Calinski–Harabasz means (optionally weighted by
    valid entries / max valid entries), rounded half-even, short model names, sorted."""
    names = ["sil_score", "db_score", "ch_score", "valid_entries"]
    g = group_metrics(of_frequency(results, frequency), names)
    if weighted:
        g = with_global(g, F.max, "valid_entries", "_max_valid")
        for m in ("sil_score", "db_score", "ch_score"):
            g = g.withColumn(m, F.try_divide(F.col(m) * F.col("valid_entries"), F.col("_max_valid")))
        g = g.drop("_max_valid")
    else:
        g = g.drop("valid_entries")
    g = with_short_names(g)
    cols = [F.col("model"), F.col("algorithm"),
            np_round("sil_score", places).alias("silhouette"),
            np_round("db_score", places).alias("davies_bouldin"),
            np_round("ch_score", places).alias("calinski_harabasz")]
    if weighted:
        cols.append(F.col("valid_entries").cast("long").alias("valid_entries"))
    return g.select(*cols).orderBy("model", "algorithm")


def full_grid(results: DataFrame, algorithms: Iterable[str]) -> DataFrame:
    """C7 grid: every embedder seen × every registry algorithm (explode of the fixed registry,
    no join)."""
    return (results.select("embedder").distinct()
            .select("embedder", F.explode(F.array(*[F.lit(a) for a in algorithms])).alias("algorithm")))


def cluster_nature(results: DataFrame, frequency: str, algorithms: Iterable[str], places: int = 3) -> DataFrame:
    """Mean number of clusters, noise %, cluster size over valid rows; the whole
    (embedder × algorithm) grid is kept, missing combinations as NULL (C7)."""
    g = group_metrics(of_frequency(results, frequency), ["n_clusters", "noise_percentage", "avg_cluster_size"])
    grid = full_grid(of_frequency(results, frequency), algorithms)
    out = with_short_names(grid.join(g, KEYS, "left"))
    return out.select("model", "algorithm",
                      np_round("n_clusters", places).alias("n_clusters"),
                      np_round("noise_percentage", places).alias("noise_percentage"),
                      np_round("avg_cluster_size", places).alias("avg_cluster_size")).orderBy("model", "algorithm")


def best_marks(report: DataFrame, maximise: Iterable[str] = (), minimise: Iterable[str] = ()) -> DataFrame:
    """boolean columns marking the best value of each metric column within a report."""
    out = report
    for c in maximise:
        out = with_global(out, F.max, c, f"_m_{c}").withColumn(f"best_{c}", F.col(c) == F.col(f"_m_{c}")).drop(f"_m_{c}")
    for c in minimise:
        out = with_global(out, F.min, c, f"_m_{c}").withColumn(f"best_{c}", F.col(c) == F.col(f"_m_{c}")).drop(f"_m_{c}")
    return out


def leaderboards(results: DataFrame) -> DataFrame:
    """F8: rank of each result within its (frequency, tag) per metric
    (silhouette desc, Davies–Bouldin asc, Calinski–Harabasz desc)."""
    w = Window.partitionBy("frequency", "tag")
    return results.select(
        "frequency", "tag", "algorithm", "embedder",
        F.rank().over(w.orderBy(F.desc_nulls_last("sil_score"))).cast("long").alias("sil_rank"),
        F.rank().over(w.orderBy(F.asc_nulls_last("db_score"))).cast("long").alias("db_rank"),
        F.rank().over(w.orderBy(F.desc_nulls_last("ch_score"))).cast("long").alias("ch_rank"))


def silhouette_pivot(results: DataFrame, algorithms: Iterable[str], places: int | None = 5) -> DataFrame:
    """D20 + F10: embedder × algorithm silhouette table of a tag, and the highest cell per tag
    (computed over the non-null values, before the pivot)."""
    algorithms = list(algorithms)
    w = Window.partitionBy("frequency", "tag")
    base = results.withColumn("_best", F.max("sil_score").over(w))
    piv = (base.groupBy("frequency", "tag", "embedder")
           .pivot("algorithm", algorithms)
           .agg(_display(exact_avg("sil_score"), places)))
    best = base.groupBy("frequency", "tag").agg(_display(F.max("_best"), places).alias("highest"))
    return piv.join(best, ["frequency", "tag"])


def _display(c, places):
    return c if places is None else F.round(c, places)


def score_lookup(results: DataFrame, frequency: str, tag: str, algorithm: str, embedder: str) -> DataFrame:
    """Silhouette of one (frequency, tag, algorithm, embedder), success rows only; NULL if missing."""
    hit = results.where((F.col("frequency") == frequency) & (F.col("tag") == tag)
                        & (F.col("algorithm") == algorithm) & (F.col("embedder") == embedder)
                        & F.col("success"))
    return hit.agg(exact_avg("sil_score").alias("sil_score"))


def valid_results(results: DataFrame) -> DataFrame:
    """Success rows with a silhouette, projected, best first."""
    return (results.where(F.col("success") & F.col("sil_score").isNotNull())
            .select("frequency", "tag", "algorithm", "embedder", "sil_score")
            .orderBy(F.desc("sil_score")))


def display_columns(results: DataFrame) -> DataFrame:
    """Derived display columns: ignored = total − valid, fixed decimals."""
    return results.select("frequency", "tag", "algorithm", "embedder",
                          (F.col("tweets") - F.col("valid_tweets")).alias("ignored"),
                          F.bround(F.col("noise_percentage") * 100, 2).alias("noise_pct"),
                          F.bround("avg_cluster_size", 2).alias("avg_cluster_size"))
