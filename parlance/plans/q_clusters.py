"""Clustering queries (J1–J8, K4 on k-means centres)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..clustering import kmeans as KM
from ..clustering.dbscan import dbscan, dbscan_sql
from ..clustering.density import density_cuts, density_cuts_sql
from ..clustering.registry import registry as cluster_registry
from ..sources import tables as S
from .q_vectors import CENT_SQL, V, _pts
from .registry import query


@query("j1_kmeans")
def j1_kmeans(spark, sf_dir):
    """k = 5, fixed seed; (id, label) of every point."""
    labels, _ = KM.kmeans(_pts(spark, sf_dir).drop("label"), 5)
    return labels.select("id", "label")


@query("j1_assign_to_centres", lambda: f"""WITH v AS ({V}), {CENT_SQL}
SELECT doc_id AS id, CAST(arg_min(ca.label, list_distance(v.features, ca.cen) ^ 2) AS INTEGER) AS label
FROM v, ca GROUP BY doc_id""")
def j1_assign_to_centres(spark, sf_dir):
    """The assignment step of J1 with given centres (the label centroids): nearest centre per point."""
    from ..operators.quality import centroids
    pts = _pts(spark, sf_dir)
    cents = centroids(pts).select(F.col("label").alias("centre"), "centroid")
    return KM.nearest_centre(pts.drop("label"), cents, []).select("id", F.col("label").cast("int"))


@query("j2_kmeans_auto_k")
def j2_kmeans_auto_k(spark, sf_dir):
    """K in 2..5 fitted together, exact silhouette per k, best k kept."""
    chosen, table = KM.kmeans_auto_k(_pts(spark, sf_dir).drop("label"))
    return chosen


@query("j2_k_table")
def j2_k_table(spark, sf_dir):
    """Silhouette and inertia for each k (the experiment table)."""
    _, table = KM.kmeans_auto_k(_pts(spark, sf_dir).drop("label"))
    return table.select("k", "silhouette", "inertia")


@query("j3_kmeans_without_noise")
def j3_kmeans_without_noise(spark, sf_dir):
    return KM.kmeans_without_noise(_pts(spark, sf_dir).drop("label"))


@query("j4_minibatch_kmeans")
def j4_minibatch_kmeans(spark, sf_dir):
    labels, _ = KM.minibatch_kmeans(_pts(spark, sf_dir).drop("label"), 5)
    return labels.select("id", "label")


@query("j5_bisecting")
def j5_bisecting(spark, sf_dir):
    return KM.bisecting(_pts(spark, sf_dir).drop("label"), k=2)


@query("j5_agglomerative")
def j5_agglomerative(spark, sf_dir):
    """Ward's hierarchy bottom-up, cut at two clusters (the top-down model is ``j5_bisecting``)."""
    from ..clustering.agglomerative import ward
    return ward(_pts(spark, sf_dir).drop("label"), 2)


@query("j6_dbscan_by_label_group", lambda: " UNION ALL ".join(
    f"SELECT {g} AS grp, * FROM ({dbscan_sql(f'SELECT doc_id, features FROM ({V}) WHERE label % 2 = {g}', 1.15, 5)})"
    for g in (0, 1)))
def j6_dbscan_by_label_group(spark, sf_dir):
    """J6 run for several groups in one job (group = label parity plays the tag)."""
    pts = _pts(spark, sf_dir).withColumn("grp", (F.col("label") % 2).cast("int"))
    return dbscan(pts, 1.15, 5, ["grp"])


EPS_LIST = (1.10, 1.15, 1.20)


@query("j8_density_cuts", lambda: density_cuts_sql(V, EPS_LIST, 5))
def j8_density_cuts(spark, sf_dir):
    """J8 (re-aimed OPTICS): DBSCAN* clusters at several eps′ at once (eps′ is a group key)."""
    return density_cuts(_pts(spark, sf_dir), EPS_LIST, 5)


@query("j7_core_distances", lambda: f"""WITH v AS ({V})
SELECT id, max(distance) AS core FROM (
  SELECT a.doc_id AS id, list_distance(a.features, b.features) AS distance,
    row_number() OVER (PARTITION BY a.doc_id ORDER BY list_distance(a.features, b.features), b.doc_id) AS rn
  FROM v a JOIN v b ON a.doc_id <> b.doc_id) WHERE rn <= 4 GROUP BY id""")
def j7_core_distances(spark, sf_dir):
    """J7 step 1: core distance with min_samples 5 (self counted)."""
    from ..clustering.hdbscan import core_distances
    return core_distances(_pts(spark, sf_dir).drop("label"), 5)


@query("j7_mst")
def j7_mst(spark, sf_dir):
    """J7 step 2: minimum spanning tree of the mutual-reachability graph."""
    from ..clustering.hdbscan import mst
    return mst(_pts(spark, sf_dir).drop("label"), 5)


@query("j7_density_cut")
def j7_density_cut(spark, sf_dir):
    from ..clustering.hdbscan import mst_density_cut
    return mst_density_cut(_pts(spark, sf_dir).drop("label"), min_cluster_size=5)


@query("j7_hdbscan")
def j7_hdbscan(spark, sf_dir):
    """HDBSCAN with excess of mass, min_cluster_size 5, of the vectors of each label parity (two groups in one run)."""
    from ..clustering.hdbscan import hdbscan
    pts = _pts(spark, sf_dir).withColumn("grp", (F.col("label") % 2).cast("int")).drop("label")
    return hdbscan(pts, 5, group_cols=["grp"])


AP_NEIGHBOURS, AP_PREFERENCE = 8, -1.5


@query("j10_affinity_step", lambda: f"""WITH v AS ({V}),
n AS (SELECT * FROM (SELECT a.doc_id AS i, b.doc_id AS k, list_distance(a.features, b.features) AS d,
    row_number() OVER (PARTITION BY a.doc_id ORDER BY list_distance(a.features, b.features), b.doc_id) AS q
  FROM v a JOIN v b ON a.doc_id <> b.doc_id) WHERE q <= {AP_NEIGHBOURS}),
e AS (SELECT i, k, -d * d AS s FROM n UNION ALL SELECT doc_id, doc_id, CAST({AP_PREFERENCE} AS DOUBLE) FROM v),
m AS (SELECT x.i, x.k, x.s, max(y.s) AS o FROM e x JOIN e y ON x.i = y.i AND x.k <> y.k GROUP BY ALL),
r AS (SELECT i, k, s, 0.5 * (s - o) AS r FROM m),
p AS (SELECT k, sum(CASE WHEN i <> k THEN greatest(r, 0) ELSE 0 END) AS p, max(CASE WHEN i = k THEN r END) AS own FROM r GROUP BY k)
SELECT r.i, r.k, r.s, r.r, 0.5 * (CASE WHEN r.i = r.k THEN p ELSE least(0, own + p - greatest(r.r, 0)) END) AS a FROM r JOIN p ON p.k = r.k""")
def j10_affinity_step(spark, sf_dir):
    """The graph and the first round of messages."""
    from ..clustering import affinity as AF
    edges = AF.graph(_pts(spark, sf_dir).drop("label"), neighbours=AP_NEIGHBOURS, preference=AP_PREFERENCE)
    return AF.send(edges.withColumn("r", F.lit(0.0)).withColumn("a", F.lit(0.0)))


@query("j10_affinity")
def j10_affinity(spark, sf_dir):
    """Affinity propagation of the vectors of each label (labels are the groups, so each is clustered within)."""
    reg = cluster_registry()
    return reg["Affinity"](_pts(spark, sf_dir).withColumnRenamed("label", "grp"), ["grp"])


@query("j11_affinity_matrix", lambda: f"""WITH v AS ({V}),
n AS (SELECT * FROM (SELECT a.doc_id AS i, b.doc_id AS j, list_distance(a.features, b.features) AS d,
    row_number() OVER (PARTITION BY a.doc_id ORDER BY list_distance(a.features, b.features), b.doc_id) AS q
  FROM v a JOIN v b ON a.doc_id <> b.doc_id) WHERE q <= 10),
w AS (SELECT i, j, max(exp(-d * d)) AS w FROM (SELECT i, j, d FROM n UNION ALL SELECT j, i, d FROM n) GROUP BY i, j),
s AS (SELECT i, sum(w) AS degree FROM w GROUP BY i)
SELECT w.i, w.j, w / sqrt(a.degree) / sqrt(b.degree) AS m FROM w JOIN s a ON a.i = w.i JOIN s b ON b.i = w.j WHERE w > 0""")
def j11_affinity_matrix(spark, sf_dir):
    """The normalised affinity matrix of the neighbour graph, as (i, j, m)."""
    from ..clustering import spectral as SP
    pts = _pts(spark, sf_dir).drop("label")
    return SP.normalised(SP.graph(pts), pts)[0]


@query("j11_eigenvalues")
def j11_eigenvalues(spark, sf_dir):
    """The four largest eigenvalues of that matrix."""
    from ..clustering import spectral as SP
    theta = SP.embedding(_pts(spark, sf_dir).drop("label")).select("theta").limit(1)
    return theta.select(F.posexplode("theta").alias("position", "eigenvalue"))


@query("j11_spectral")
def j11_spectral(spark, sf_dir):
    """Spectral clustering, k in 2..4 by the silhouette."""
    from ..clustering.spectral import spectral
    return spectral(_pts(spark, sf_dir).drop("label"))


@query("p2_cluster_tags")
def p2_cluster_tags(spark, sf_dir):
    """Every weekly tag × embedder × algorithm clustered, scored, stored (A10–A12, F8) and read back with
    its leaderboard ranks."""
    from ..streaming.ingest import scratch
    from .cluster_tags import EMBEDDERS, cluster_tags, store_results
    rows = cluster_tags(spark, sf_dir, embedders=EMBEDDERS, algorithms=tuple(cluster_registry()))["rows"]
    paths = store_results(rows, scratch(spark, "p2"))
    ranks = spark.read.parquet(paths["leaderboards"])
    return (spark.read.schema(rows.schema).parquet(paths["rows"]).drop("time", "themes", "sentiment")
            .join(ranks, ["frequency", "tag", "algorithm", "embedder"]))


@query("p2_cluster_themes")
def p2_cluster_themes(spark, sf_dir):
    """P2 side outputs: cluster themes (F2) per combination and cluster."""
    from .cluster_tags import cluster_tags
    return cluster_tags(spark, sf_dir, algorithms=("K-Means", "HDBSCAN"))["themes"]


@query("j9_mean_shift")
def j9_mean_shift(spark, sf_dir):
    """Flat-kernel mean-shift, every point a seed, bandwidth estimated (quantile 0.3)."""
    from ..clustering.meanshift import mean_shift
    return mean_shift(_pts(spark, sf_dir).drop("label"))


@query("j9_mean_shift_not_all")
def j9_mean_shift_not_all(spark, sf_dir):
    """J9 with ``cluster_all = False``: points outside the bandwidth of every mode are noise."""
    from ..clustering.meanshift import mean_shift
    return mean_shift(_pts(spark, sf_dir).drop("label"), cluster_all=False)
