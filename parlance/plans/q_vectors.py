"""Queries over vectors: K1–K4, D12–D15, F6, C9, C10, F7, I7, J6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..clustering.dbscan import dbscan, dbscan_sql
from ..operators import neighbours as NB
from ..operators import quality as Q
from ..sources import tables as S
from .registry import query

V = S.vectors_sql()
VN = S.vectors_sql(noise=True)
EPS, MIN_SAMPLES = 1.15, 5          # DBSCAN parameters that give a non-trivial answer on `embeddings`
FINE_LABELS = "(doc_id * 7919) % 150"  # a fine labelling with many small clusters (F6 input)


def _pts(spark, sf_dir, noise=False):
    return S.vectors(spark, sf_dir, noise).withColumnRenamed("doc_id", "id")


def _dist_sql(a, b, metric):
    if metric == "cosine":
        return f"greatest(0.0, 1.0 - list_cosine_similarity({a}, {b}))"
    return f"list_distance({a}, {b})"


def _silhouette_sql(src, metric="euclidean"):
    return f"""WITH v AS ({src}),
d AS (SELECT a.doc_id AS i, a.label AS li, b.label AS lj, {_dist_sql('a.features', 'b.features', metric)} AS dist
      FROM v a JOIN v b ON a.doc_id <> b.doc_id),
m AS (SELECT i, li, lj, avg(dist) AS md FROM d GROUP BY ALL),
s AS (SELECT i, max(CASE WHEN lj = li THEN md END) AS a, min(CASE WHEN lj <> li THEN md END) AS b FROM m GROUP BY i)
SELECT CASE WHEN count(b) > 0 THEN avg(CASE WHEN a IS NULL THEN 0 WHEN greatest(a, b) = 0 THEN 0
  ELSE (b - a) / greatest(a, b) END) END AS silhouette FROM s"""


@query("k1_silhouette", lambda: _silhouette_sql(V))
def k1_silhouette(spark, sf_dir):
    return Q.silhouette(_pts(spark, sf_dir))


@query("k1_silhouette_cosine", lambda: _silhouette_sql(V, "cosine"))
def k1_silhouette_cosine(spark, sf_dir):
    return Q.silhouette(_pts(spark, sf_dir), metric="cosine")


@query("k1_silhouette_with_noise", lambda: _silhouette_sql(VN))
def k1_silhouette_with_noise(spark, sf_dir):
    """Noise kept as its own cluster −1 (as in the parameter experiments)."""
    return Q.silhouette(_pts(spark, sf_dir, noise=True))


CENT_SQL = """ex AS (SELECT label, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM v),
c AS (SELECT label, pos, avg(x) AS cx FROM ex GROUP BY ALL),
ca AS (SELECT label, list(cx ORDER BY pos) AS cen FROM c GROUP BY label)"""


@query("k2_davies_bouldin", lambda: f"""WITH v AS ({V}), {CENT_SQL},
sp AS (SELECT v.label, avg(list_distance(v.features, ca.cen)) AS s FROM v JOIN ca USING (label) GROUP BY ALL),
pr AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.cen, b.cen)) AS r FROM ca a JOIN ca b ON a.label <> b.label
       JOIN sp sa ON sa.label = a.label JOIN sp sb ON sb.label = b.label GROUP BY a.label)
SELECT avg(r) AS davies_bouldin FROM pr""")
def k2_davies_bouldin(spark, sf_dir):
    return Q.davies_bouldin(_pts(spark, sf_dir))


@query("k3_calinski_harabasz", lambda: f"""WITH v AS ({V}), {CENT_SQL},
sz AS (SELECT label, count(*) AS n FROM v GROUP BY label),
ov AS (SELECT list(mx ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS mx FROM ex GROUP BY pos)),
w AS (SELECT sum(list_distance(v.features, ca.cen) ^ 2) AS within FROM v JOIN ca USING (label)),
b AS (SELECT sum(sz.n * list_distance(ca.cen, ov.mean) ^ 2) AS between, count(*) AS k FROM ca JOIN sz USING (label), ov)
SELECT (between / (k - 1)) / (within / ((SELECT count(*) FROM v) - k)) AS calinski_harabasz FROM b, w""")
def k3_calinski_harabasz(spark, sf_dir):
    return Q.calinski_harabasz(_pts(spark, sf_dir))


@query("k4_inertia", lambda: f"""WITH v AS ({V}), {CENT_SQL}
SELECT sum(list_distance(v.features, ca.cen) ^ 2) AS inertia FROM v JOIN ca USING (label)""")
def k4_inertia(spark, sf_dir):
    return Q.inertia(_pts(spark, sf_dir))


def _f6_sql(src):
    return f"""WITH v AS ({src}),
st AS (SELECT label, count(*) AS n, min(doc_id) AS first FROM v GROUP BY label),
k AS (SELECT label, CAST(dense_rank() OVER (ORDER BY first) - 1 AS INTEGER) AS new FROM st WHERE label <> -1 AND n >= 4)
SELECT v.doc_id AS id, CAST(coalesce(k.new, -1) AS INTEGER) AS label FROM v LEFT JOIN k USING (label)"""


FINE_SQL = f"SELECT doc_id, CAST({FINE_LABELS} AS INTEGER) AS label FROM ({V})"


@query("f6_small_cluster_removal", lambda: _f6_sql(FINE_SQL))
def f6_small_cluster_removal(spark, sf_dir):
    pts = _pts(spark, sf_dir).withColumn("label", ((F.col("id") * 7919) % 150).cast("int"))
    return Q.remove_small_clusters(pts.select("id", "label"))


@query("d13_cluster_lengths", lambda: f"""SELECT label, count(*) AS size FROM ({_f6_sql(FINE_SQL)}) GROUP BY label""")
def d13_cluster_lengths(spark, sf_dir):
    pts = _pts(spark, sf_dir).withColumn("label", ((F.col("id") * 7919) % 150).cast("int"))
    return Q.cluster_lengths(Q.remove_small_clusters(pts.select("id", "label")))


def _stats_sql(src):
    return f"""WITH s AS (SELECT label, count(*) AS size FROM ({src}) GROUP BY label)
SELECT count(CASE WHEN label <> -1 THEN 1 END) AS n_clusters,
  round_even(avg(CASE WHEN label <> -1 THEN size END), 2) AS avg_cluster_size,
  min(CASE WHEN label <> -1 THEN size END) AS min_cluster_size, max(CASE WHEN label <> -1 THEN size END) AS max_cluster_size,
  CAST(coalesce(sum(CASE WHEN label = -1 THEN size END), 0) AS BIGINT) AS noise_amount, CAST(sum(size) AS BIGINT) AS total,
  round_even(coalesce(sum(CASE WHEN label = -1 THEN size END), 0) / sum(size), 2) AS noise_fraction,
  coalesce(sum(CASE WHEN label = -1 THEN size END), 0) > 0 AS has_noise FROM s"""


@query("d12_d14_cluster_stats", lambda: _stats_sql(_f6_sql(FINE_SQL)))
def d12_d14_cluster_stats(spark, sf_dir):
    pts = _pts(spark, sf_dir).withColumn("label", ((F.col("id") * 7919) % 150).cast("int"))
    st = Q.cluster_stats(Q.remove_small_clusters(pts.select("id", "label")))
    return st.select(*[F.col(c).cast("long") if c in ("n_clusters", "min_cluster_size", "max_cluster_size",
                                                         "noise_amount", "total") else F.col(c) for c in st.columns])


@query("d15_norm_stats", lambda: f"""SELECT label, min(n) AS norm_min, max(n) AS norm_max, avg(n) AS norm_mean
FROM (SELECT label, sqrt(list_sum(list_transform(features, lambda x: x * x))) AS n FROM ({V})) GROUP BY label""")
def d15_norm_stats(spark, sf_dir):
    return Q.norm_stats(_pts(spark, sf_dir), ["label"])


@query("i7_standardise", lambda: f"""WITH v AS ({V}),
ex AS (SELECT doc_id, unnest(features) AS x, generate_subscripts(features, 1) AS pos FROM v),
st AS (SELECT pos, avg(x) AS mu, stddev_pop(x) AS sd FROM ex GROUP BY pos)
SELECT doc_id AS id, CAST(pos - 1 AS INTEGER) AS pos, CASE WHEN sd = 0 THEN x - mu ELSE (x - mu) / sd END AS value
FROM ex JOIN st USING (pos)""")
def i7_standardise(spark, sf_dir):
    z = Q.standardise(_pts(spark, sf_dir))
    return z.select("id", F.posexplode("features").alias("pos", "value")).select(
        "id", F.col("pos").cast("int"), "value")


def _knn_sql(src, k, metric="euclidean"):
    return f"""WITH v AS ({src})
SELECT i AS id, CAST(rn AS INTEGER) AS rank, j AS neighbour, dist AS distance FROM (
  SELECT a.doc_id AS i, b.doc_id AS j, {_dist_sql('a.features', 'b.features', metric)} AS dist,
    row_number() OVER (PARTITION BY a.doc_id ORDER BY {_dist_sql('a.features', 'b.features', metric)}, b.doc_id) AS rn
  FROM v a JOIN v b ON a.doc_id <> b.doc_id) WHERE rn <= {k}"""


@query("c9_knn", lambda: _knn_sql(V, 3))
def c9_knn(spark, sf_dir):
    return NB.knn(_pts(spark, sf_dir), k=3)


@query("c9_knn_pruned", lambda: _knn_sql(V, 3))
def c9_knn_pruned(spark, sf_dir):
    """C9 with blocks skipped by the triangle inequality: the rows of ``c9_knn``."""
    from ..operators.pruned import knn_pruned
    return knn_pruned(_pts(spark, sf_dir), 3)


@query("c9_pruned_visits")
def c9_pruned_visits(spark, sf_dir):
    """Visits of points to blocks made and skipped, for the points of each label."""
    from ..operators.pruned import report
    return report(_pts(spark, sf_dir), 3, ["label"], pivots=4)


@query("c9_knn_cosine", lambda: _knn_sql(V, 1, "cosine"))
def c9_knn_cosine(spark, sf_dir):
    return NB.knn(_pts(spark, sf_dir), k=1, metric="cosine")


@query("c10_range_pairs", lambda: f"""WITH v AS ({V})
SELECT a.doc_id AS id, b.doc_id AS other, list_distance(a.features, b.features) AS distance
FROM v a JOIN v b ON a.doc_id < b.doc_id AND list_distance(a.features, b.features) <= {EPS}""")
def c10_range_pairs(spark, sf_dir):
    return NB.range_pairs(_pts(spark, sf_dir), EPS)


@query("f7_knn_curve", lambda: f"""SELECT CAST(row_number() OVER (ORDER BY distance) - 1 AS BIGINT) AS position, distance
FROM ({_knn_sql(V, 1)})""")
def f7_knn_curve(spark, sf_dir):
    nn = NB.knn(_pts(spark, sf_dir), k=1)
    return NB.sorted_curve(nn.select("distance"))


@query("j6_dbscan", lambda: dbscan_sql(V, EPS, MIN_SAMPLES))
def j6_dbscan(spark, sf_dir):
    return dbscan(_pts(spark, sf_dir), EPS, MIN_SAMPLES)
