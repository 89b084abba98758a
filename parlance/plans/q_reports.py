"""Report queries over result rows."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import io as IO
from ..sources import tables as S
from .registry import query as _register


def query(name, sql=None):
    """Register with a twin whose averages are taken in decimals, as the reports' are."""
    twin = None if sql is None else lambda: R.exact_averages_sql(sql() if callable(sql) else sql)
    return _register(name, twin)

RR = f"WITH result_rows AS ({S.RESULT_ROWS_SQL})\n"
FREQ = "daily"
FIXTURE_ALGORITHMS = ("click", "error", "purchase", "signup", "view")
SHORT = "(" + " UNION ALL ".join(
    f"SELECT '{k}' AS embedder, '{v}' AS model UNION ALL SELECT '{k} (50-d)', '{v} (50-d)'"
    for k, v in R.EMBEDDER_SHORT_NAMES.items()) + ")"


def _rows(spark, sf_dir):
    return S.result_rows(spark, sf_dir)


def _avg_sql(metric_expr, name, valid_only):
    cond = f"{metric_expr.split(' ')[0]} IS NOT NULL AND sil_score IS NOT NULL" if valid_only else None
    where = f" AND {cond}" if cond else ""
    return (RR + f"SELECT algorithm, embedder, avg({metric_expr}) AS {name} FROM result_rows "
            f"WHERE frequency = '{FREQ}'{where} GROUP BY algorithm, embedder")


@query("d2_valid_entries", lambda: RR + f"""SELECT algorithm, embedder, count(sil_score) AS valid_entries
FROM result_rows WHERE frequency = '{FREQ}' GROUP BY algorithm, embedder""")
def d2_valid_entries(spark, sf_dir):
    return R.average_metric(_rows(spark, sf_dir), FREQ, "valid_entries")


@query("d3_avg_n_clusters", lambda: _avg_sql("n_clusters", "n_clusters", True))
def d3_avg_n_clusters(spark, sf_dir):
    return R.average_metric(_rows(spark, sf_dir), FREQ, "n_clusters")


@query("d4_avg_noise_percentage", lambda: _avg_sql("noise_percentage * 100.0", "noise_percentage", True))
def d4_avg_noise_percentage(spark, sf_dir):
    return R.average_metric(_rows(spark, sf_dir), FREQ, "noise_percentage")


@query("d5_avg_cluster_size", lambda: _avg_sql("avg_cluster_size", "avg_cluster_size", True))
def d5_avg_cluster_size(spark, sf_dir):
    return R.average_metric(_rows(spark, sf_dir), FREQ, "avg_cluster_size")


@query("d6_avg_silhouette", lambda: _avg_sql("sil_score", "sil_score", False))
def d6_avg_silhouette(spark, sf_dir):
    return R.average_metric(_rows(spark, sf_dir), FREQ, "sil_score")


@query("d7_avg_davies_bouldin", lambda: _avg_sql("db_score", "db_score", False))
def d7_avg_davies_bouldin(spark, sf_dir):
    return R.average_metric(_rows(spark, sf_dir), FREQ, "db_score")


@query("d8_avg_calinski_harabasz", lambda: _avg_sql("ch_score", "ch_score", False))
def d8_avg_calinski_harabasz(spark, sf_dir):
    return R.average_metric(_rows(spark, sf_dir), FREQ, "ch_score")


CONSOLIDATED_SQL = f"""SELECT algorithm, embedder, sil_score, valid_entries,
  sil_score * valid_entries / max(valid_entries) OVER () AS weighted_score
FROM (SELECT algorithm, embedder, avg(sil_score) AS sil_score, count(sil_score) AS valid_entries
      FROM result_rows WHERE frequency = '{FREQ}' GROUP BY algorithm, embedder)"""


@query("d9_consolidated", lambda: RR + CONSOLIDATED_SQL)
def d9_consolidated(spark, sf_dir):
    return R.consolidated(_rows(spark, sf_dir), FREQ)


def _three_sql(weighted):
    w = " * valid_entries / max(valid_entries) OVER ()" if weighted else ""
    extra = ", valid_entries" if weighted else ""
    return RR + f"""SELECT coalesce(s.model, g.embedder) AS model, algorithm,
  (round_even((sil{w}) * 1000, 0) / 1000) AS silhouette, (round_even((db{w}) * 1000, 0) / 1000) AS davies_bouldin,
  (round_even((ch{w}) * 1000, 0) / 1000) AS calinski_harabasz{extra}
FROM (SELECT algorithm, embedder, avg(sil_score) AS sil, avg(db_score) AS db, avg(ch_score) AS ch,
        count(sil_score) AS valid_entries FROM result_rows WHERE frequency = '{FREQ}'
      GROUP BY algorithm, embedder) g LEFT JOIN {SHORT} s ON s.embedder = g.embedder"""


@query("d10_three_averages", lambda: _three_sql(False))
def d10_three_averages(spark, sf_dir):
    return R.three_averages(_rows(spark, sf_dir), FREQ)


@query("d10w_three_weighted_averages", lambda: _three_sql(True))
def d10w_three_weighted_averages(spark, sf_dir):
    return R.three_averages(_rows(spark, sf_dir), FREQ, weighted=True)


def _nature_sql():
    algs = ", ".join(f"('{a}')" for a in FIXTURE_ALGORITHMS)
    valid = "sil_score IS NOT NULL AND {c} IS NOT NULL"
    return RR + f"""SELECT coalesce(s.model, grid.embedder) AS model, grid.algorithm,
  (round_even((n_clusters) * 1000, 0) / 1000) AS n_clusters, (round_even((noise_percentage) * 1000, 0) / 1000) AS noise_percentage,
  (round_even((avg_cluster_size) * 1000, 0) / 1000) AS avg_cluster_size
FROM (SELECT DISTINCT embedder, a.algorithm FROM result_rows CROSS JOIN (VALUES {algs}) a(algorithm)
      WHERE frequency = '{FREQ}') grid
LEFT JOIN (SELECT algorithm, embedder,
    avg(CASE WHEN {valid.format(c='n_clusters')} THEN n_clusters END) AS n_clusters,
    avg(CASE WHEN {valid.format(c='noise_percentage')} THEN noise_percentage * 100.0 END) AS noise_percentage,
    avg(CASE WHEN {valid.format(c='avg_cluster_size')} THEN avg_cluster_size END) AS avg_cluster_size
  FROM result_rows WHERE frequency = '{FREQ}' GROUP BY algorithm, embedder) g
  ON g.algorithm = grid.algorithm AND g.embedder = grid.embedder
LEFT JOIN {SHORT} s ON s.embedder = grid.embedder"""


@query("d11_cluster_nature", _nature_sql)
def d11_cluster_nature(spark, sf_dir):
    return R.cluster_nature(_rows(spark, sf_dir), FREQ, FIXTURE_ALGORITHMS)


@query("c3_metrics_aligned", lambda: RR + f"""SELECT coalesce(a.algorithm, b.algorithm) AS algorithm,
  coalesce(a.embedder, b.embedder) AS embedder, a.sil_score, b.n_clusters FROM
 (SELECT algorithm, embedder, avg(sil_score) AS sil_score FROM result_rows WHERE tag < '2024-01-16' GROUP BY ALL) a
 FULL JOIN (SELECT algorithm, embedder, avg(n_clusters) AS n_clusters FROM result_rows
            WHERE tag >= '2024-01-16' AND sil_score IS NOT NULL GROUP BY ALL) b
 ON a.algorithm = b.algorithm AND a.embedder = b.embedder""")
def c3_metrics_aligned(spark, sf_dir):
    """Metric frames with different row filters aligned by a full outer join on the keys."""
    rows = _rows(spark, sf_dir)
    a = rows.where(F.col("tag") < "2024-01-16").groupBy(*R.KEYS).agg(R.exact_avg("sil_score").alias("sil_score"))
    b = (rows.where((F.col("tag") >= "2024-01-16") & F.col("sil_score").isNotNull())
         .groupBy(*R.KEYS).agg(R.exact_avg("n_clusters").alias("n_clusters")))
    return a.join(b, R.KEYS, "full")


@query("c5_short_names", lambda: RR + f"""SELECT r.embedder, coalesce(s.model, r.embedder) AS model, count(*) AS rows
FROM result_rows r LEFT JOIN {SHORT} s ON s.embedder = r.embedder GROUP BY ALL""")
def c5_short_names(spark, sf_dir):
    return (R.with_short_names(_rows(spark, sf_dir)).groupBy("embedder", "model")
            .agg(F.count(F.lit(1)).alias("rows")))


@query("f8_leaderboards", lambda: RR + """SELECT frequency, tag, algorithm, embedder,
  rank() OVER (PARTITION BY frequency, tag ORDER BY sil_score DESC NULLS LAST) AS sil_rank,
  rank() OVER (PARTITION BY frequency, tag ORDER BY db_score ASC NULLS LAST) AS db_rank,
  rank() OVER (PARTITION BY frequency, tag ORDER BY ch_score DESC NULLS LAST) AS ch_rank
FROM result_rows""")
def f8_leaderboards(spark, sf_dir):
    return R.leaderboards(_rows(spark, sf_dir))


@query("f9_best_marks", lambda: RR + f"""SELECT *, silhouette = max(silhouette) OVER () AS best_silhouette,
  davies_bouldin = min(davies_bouldin) OVER () AS best_davies_bouldin,
  calinski_harabasz = max(calinski_harabasz) OVER () AS best_calinski_harabasz
FROM ({_three_sql(False)[len(RR):]})""")
def f9_best_marks(spark, sf_dir):
    rep = R.three_averages(_rows(spark, sf_dir), FREQ)
    return R.best_marks(rep, maximise=["silhouette", "calinski_harabasz"], minimise=["davies_bouldin"])


def _pivot_sql():
    cells = ", ".join(f"avg(CASE WHEN algorithm = '{a}' THEN sil_score END) AS {a}"
                      for a in FIXTURE_ALGORITHMS)
    return RR + f"""SELECT p.*, h.highest FROM
 (SELECT frequency, tag, embedder, {cells} FROM result_rows GROUP BY frequency, tag, embedder) p
 JOIN (SELECT frequency, tag, max(sil_score) AS highest FROM result_rows GROUP BY ALL) h
 USING (frequency, tag)"""


@query("d20_silhouette_pivot", _pivot_sql)
def d20_silhouette_pivot(spark, sf_dir):
    return R.silhouette_pivot(_rows(spark, sf_dir), FIXTURE_ALGORITHMS, places=None)


@query("b7_score_lookup", lambda: RR + """SELECT avg(sil_score) AS sil_score FROM result_rows
WHERE frequency = 'daily' AND tag = '2024-01-15' AND algorithm = 'click' AND embedder = 'emb1' AND success""")
def b7_score_lookup(spark, sf_dir):
    return R.score_lookup(_rows(spark, sf_dir), "daily", "2024-01-15", "click", "emb1")


@query("b8_valid_results", lambda: RR + """SELECT frequency, tag, algorithm, embedder, sil_score FROM result_rows
WHERE success AND sil_score IS NOT NULL""")
def b8_valid_results(spark, sf_dir):
    return R.valid_results(_rows(spark, sf_dir))


@query("b9_exclusions", lambda: RR + f"""SELECT algorithm, embedder, count(*) AS rows FROM result_rows
WHERE algorithm <> 'error' AND NOT contains(embedder, '3') GROUP BY ALL""")
def b9_exclusions(spark, sf_dir):
    return (R.exclude(_rows(spark, sf_dir), "error", "3").groupBy(*R.KEYS)
            .agg(F.count(F.lit(1)).alias("rows")))


@query("b10_case_study", lambda: RR + f"""SELECT coalesce(s.model, g.embedder) AS model, algorithm,
  (round_even((sil) * 1000, 0) / 1000) AS silhouette, (round_even((db) * 1000, 0) / 1000) AS davies_bouldin, (round_even((ch) * 1000, 0) / 1000) AS calinski_harabasz
FROM (SELECT algorithm, embedder, avg(sil_score) AS sil, avg(db_score) AS db, avg(ch_score) AS ch
      FROM result_rows WHERE tag = '2024-01-10' GROUP BY ALL) g LEFT JOIN {SHORT} s ON s.embedder = g.embedder""")
def b10_case_study(spark, sf_dir):
    """B10 × D10: the three averages of one named tag."""
    return R.three_averages(_rows(spark, sf_dir).where(F.col("tag") == "2024-01-10"), FREQ)


@query("b11_frequency_rows", lambda: RR + f"SELECT * FROM result_rows WHERE frequency = '{FREQ}'")
def b11_frequency_rows(spark, sf_dir):
    return R.of_frequency(_rows(spark, sf_dir), FREQ)


@query("b16_display_columns", lambda: RR + """SELECT frequency, tag, algorithm, embedder, tweets - valid_tweets AS ignored,
  round_even(noise_percentage * 100, 2) AS noise_pct, round_even(avg_cluster_size, 2) AS avg_cluster_size FROM result_rows""")
def b16_display_columns(spark, sf_dir):
    return R.display_columns(_rows(spark, sf_dir))


# ---- sinks and sources: A11–A16, P3, P4 ----------------------------------------------------------
def _scratch(spark):
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/tables/" + os.path.basename(tempfile.mktemp(prefix="t"))


@query("a13_result_csv_roundtrip", lambda: RR + """SELECT algorithm, embedder, count(sil_score) AS valid_entries,
  count(*) AS rows FROM result_rows GROUP BY ALL""")
def a13_result_csv_roundtrip(spark, sf_dir):
    """A11 → A13: write the flat result CSV (header once, missing = "None"), read it back typed."""
    path = _scratch(spark)
    IO.write_result_csv(_rows(spark, sf_dir), path)
    back = IO.read_result_csv(spark, path)
    return back.groupBy(*R.KEYS).agg(F.count("sil_score").alias("valid_entries"), F.count(F.lit(1)).alias("rows"))


@query("p3_report_tables", lambda: RR + f"""SELECT * FROM ({CONSOLIDATED_SQL})
WHERE algorithm <> 'error' AND NOT contains(embedder, '3')""".replace("FROM result_rows WHERE", "FROM result_rows WHERE algorithm <> 'error' AND NOT contains(embedder, '3') AND"))
def p3_report_tables(spark, sf_dir):
    """Result CSV → exclusions (B9) → consolidated report (D9), written as CSV (A14) and read back."""
    path = _scratch(spark)
    IO.write_result_csv(_rows(spark, sf_dir), path)
    rows = R.exclude(IO.read_result_csv(spark, path), "error", "3")
    rep = R.consolidated(rows, FREQ)
    out = path + "_report"
    rep.write.mode("overwrite").option("header", True).csv(out)
    return spark.read.schema(rep.schema).option("header", True).csv(out)


REPORT_COLUMNS = {
    "consolidated": ["sil_score", "valid_entries", "weighted_score"],
    "averages": ["silhouette", "davies_bouldin", "calinski_harabasz"],
    "weighted": ["silhouette", "davies_bouldin", "calinski_harabasz", "valid_entries"],
    "nature": ["n_clusters", "noise_percentage", "avg_cluster_size"],
    "case study": ["silhouette", "davies_bouldin", "calinski_harabasz"],
}
CASE_TAG = "2024-01-10"


def _p3_all_sql():
    assert RR.startswith("WITH result_rows AS")
    rows = (RR.replace("WITH result_rows AS", "WITH all_rows AS", 1).rstrip()
            + ", result_rows AS (SELECT * FROM all_rows WHERE algorithm <> 'error' AND NOT contains(embedder, '3'))\n")
    case = (_three_sql(False)[len(RR):]).replace(f"WHERE frequency = '{FREQ}'", f"WHERE tag = '{CASE_TAG}'")
    bodies = {"consolidated": f"SELECT embedder AS model, * FROM ({CONSOLIDATED_SQL})", "averages": _three_sql(False)[len(RR):],
              "weighted": _three_sql(True)[len(RR):], "nature": _nature_sql()[len(RR):], "case study": case}
    parts = [f"SELECT '{name}' AS report, model, algorithm, unnest([{', '.join(repr(c) for c in cols)}]) AS metric, "
             f"unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in cols)}]) AS value FROM ({bodies[name]})"
             for name, cols in REPORT_COLUMNS.items()]
    return rows + "\nUNION ALL\n".join(parts)


@query("p3_all_reports", _p3_all_sql)
def p3_all_reports(spark, sf_dir):
    """P3 in full: result CSV → exclusions (B9) → D9, D10, D10w, D11 and the case study (B10), each written
    as CSV (A14), read back, and given here in long form."""
    path = _scratch(spark)
    IO.write_result_csv(_rows(spark, sf_dir), path)
    rows = R.exclude(IO.read_result_csv(spark, path), "error", "3")
    reports = {
        "consolidated": R.consolidated(rows, FREQ).withColumnRenamed("embedder", "model"),
        "averages": R.three_averages(rows, FREQ),
        "weighted": R.three_averages(rows, FREQ, weighted=True),
        "nature": R.cluster_nature(rows, FREQ, FIXTURE_ALGORITHMS),
        "case study": R.three_averages(rows.where(F.col("tag") == CASE_TAG), FREQ),
    }
    out = None
    for name, rep in reports.items():
        target = f"{path}_{name.replace(' ', '_')}"
        rep.write.mode("overwrite").option("header", True).csv(target)
        back = spark.read.schema(rep.schema).option("header", True).csv(target)
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                    for c in REPORT_COLUMNS[name]]))
        part = back.select(F.lit(name).alias("report"), "model", "algorithm", cells.alias("c")).select(
            "report", "model", "algorithm", "c.metric", "c.value")
        out = part if out is None else out.unionByName(part)
    return out


@query("p4_consolidated_json", lambda: RR + f"""SELECT CAST(to_json(struct_pack(algorithm := algorithm, embedder := embedder,
  sil_score := round(sil_score, 6), valid_entries := valid_entries)) AS VARCHAR) AS json FROM ({CONSOLIDATED_SQL})""")
def p4_consolidated_json(spark, sf_dir):
    """Consolidated view as one JSON object per row (index columns stay columns)."""
    rep = R.consolidated(_rows(spark, sf_dir), FREQ)
    return rep.select(F.to_json(F.struct("algorithm", "embedder", F.round("sil_score", 6).alias("sil_score"),
                                         "valid_entries")).alias("json"))
