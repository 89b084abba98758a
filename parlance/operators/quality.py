"""Cluster quality and cluster-shape operators: K1–K4, F6, D12–D14, D15, I7.

Every function keeps arbitrary group keys (tag, embedder, algorithm, ...),
so all groups of a run are scored in one job.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import MIN_CLUSTER_SIZE
from . import pairs as PK
from .order import with_positions


def _schema(group_cols, dtypes: dict, extra: str) -> str:
    g = ", ".join(f"{c} {dtypes[c]}" for c in group_cols)
    return f"{g}, {extra}" if g else extra


def _one_hot(labels: np.ndarray):
    """The different labels and a column of marks for each."""
    uniq = np.unique(labels)
    return uniq, (labels[:, None] == uniq[None, :]).astype(np.float64)


# ---- K1 silhouette ---------------------------------------------------------------------------------
def _silhouette_kernel(group_cols, metric):
    def kernel(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame(columns=[*group_cols, "id", "other", "sum_d", "cnt"])
        g = PK.group_values(l, r, group_cols)
        diag = PK.same_block(l, r)
        ll, rl = l["label"].to_numpy(), r["label"].to_numpy()
        li, x = l["id"].to_numpy(), PK.matrix(l)
        # on the diagonal both sides hold the same points, possibly in another order: use the left only
        y, rl = (x, ll) if diag else (PK.matrix(r), rl)
        of_l, hot_l = _one_hot(ll)
        of_r, hot_r = _one_hot(rl)
        sums_l, sums_r = np.zeros((len(x), len(of_r))), np.zeros((len(y), len(of_l)))
        for s, d in PK.distance_strips(x, y, metric):
            if diag:
                d[np.arange(len(d)), np.arange(s, s + len(d))] = 0.0
            sums_l[s:s + len(d)] = d @ hot_r
            if not diag:
                sums_r += d.T @ hot_l[s:s + len(d)]
        out = []

        def emit(ids, sums, labels_other, onehot, self_mask):
            cnts = np.broadcast_to(onehot.sum(axis=0), sums.shape).copy()
            if self_mask is not None:
                cnts -= self_mask
            out.append(pd.DataFrame({"id": np.repeat(ids, len(labels_other)), "other": np.tile(labels_other, len(ids)),
                                     "sum_d": sums.ravel(), "cnt": cnts.ravel().astype(np.int64)}))

        emit(li, sums_l, of_r, hot_r, hot_l if diag else None)
        if not diag:
            emit(r["id"].to_numpy(), sums_r, of_l, hot_l, None)
        res = pd.concat(out, ignore_index=True)
        for c in group_cols:
            res.insert(0, c, g[c])
        return res[[*group_cols, "id", "other", "sum_d", "cnt"]]
    return kernel


def silhouette_points(points: DataFrame, group_cols: Sequence[str] = (), metric: str = "euclidean",
                      block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """Per-point silhouette. ``points``: (*group_cols, id, features ARRAY<DOUBLE>, label INT)."""
    pts, gcols = PK.ensure_group(points.select(*group_cols, "id", "features", "label"), group_cols)
    dtypes = dict(pts.dtypes)
    blocked = PK.assign_blocks(pts, gcols, "id", block_size)
    left, right = PK.replicate(blocked, symmetric=True)
    schema = _schema(gcols, dtypes, "id bigint, other int, sum_d double, cnt bigint")
    partial = PK.run_blocks(left, right, gcols, _silhouette_kernel(gcols, metric), schema)
    out = _point_silhouettes(partial, pts.select(*gcols, "id", F.col("label").alias("own")), gcols)
    return out if group_cols else out.drop("_g")


def _point_silhouettes(partial: DataFrame, own: DataFrame, gcols: Sequence[str]) -> DataFrame:
    """(*group, id, silhouette) from the sums (*group, id, other, sum_d, cnt) and the points' labels (*group, id, own)."""
    sums = partial.groupBy(*gcols, "id", "other").agg(F.sum("sum_d").alias("sum_d"), F.sum("cnt").alias("cnt"))
    per = sums.join(own, [*gcols, "id"])
    mean = F.when(F.col("cnt") > 0, F.col("sum_d") / F.col("cnt"))
    agg = per.groupBy(*gcols, "id").agg(
        F.max(F.when(F.col("other") == F.col("own"), mean)).alias("a"),
        F.max(F.when(F.col("other") == F.col("own"), F.col("cnt"))).alias("own_others"),
        F.min(F.when((F.col("other") != F.col("own")) & (F.col("cnt") > 0), mean)).alias("b"))
    s = (F.when(F.coalesce(F.col("own_others"), F.lit(0)) == 0, F.lit(0.0))
         .when(F.greatest("a", "b") == 0, F.lit(0.0))
         .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")))
    return agg.select(*gcols, "id", s.alias("silhouette"), F.col("b").isNotNull().alias("_has_other"))


def silhouette(points: DataFrame, group_cols: Sequence[str] = (), metric: str = "euclidean",
               block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """K1: mean silhouette per group; NULL when the group has fewer than 2 labels."""
    return _mean_silhouettes(silhouette_points(points, group_cols, metric, block_size), group_cols)


def _mean_silhouettes(per: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    return per.groupBy(*group_cols).agg(
        F.when(F.max(F.col("_has_other").cast("int")) == 1, F.avg("silhouette")).alias("silhouette"))


def silhouettes(points: DataFrame, labellings: int, group_cols: Sequence[str] = (), metric: str = "euclidean",
                block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """K1 of several labellings of the same points by one pair pass: (*group, labelling, silhouette).

    ``points``: (*group, id, features, labels), an array of ``labellings`` ints; a point takes no part in a labelling where its label is null.
    A labelling without points has no row."""
    pts, gcols = PK.ensure_group(points.select(*group_cols, "id", "features", "labels"), group_cols)
    dtypes = dict(pts.dtypes)

    def marks(labels):
        """(labelling, label) of every column of marks, and the columns."""
        which, names, hot = [], [], []
        for k in range(labellings):
            own = labels[:, k]
            uniq = np.unique(own[~np.isnan(own)])
            which += [k] * len(uniq)
            names += uniq.tolist()
            hot.append((own[:, None] == uniq[None, :]).astype(np.float64))
        return np.array(which, np.int32), np.array(names, np.int32), np.concatenate(hot, axis=1)

    def labels_of(pdf):
        return np.array([[np.nan if v is None else v for v in row] for row in pdf["labels"].tolist()], float).reshape(len(pdf), labellings)

    def kernel(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cols = [*gcols, "labelling", "id", "other", "sum_d", "cnt"]
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame(columns=cols)
        g, diag = PK.group_values(l, r, gcols), PK.same_block(l, r)
        ll, x = labels_of(l), PK.matrix(l)
        rl, y = (ll, x) if diag else (labels_of(r), PK.matrix(r))
        marks_l, marks_r = marks(ll), marks(rl)
        hot_l, hot_r = marks_l[2], marks_r[2]
        sums_l, sums_r = np.zeros((len(x), hot_r.shape[1])), np.zeros((len(y), hot_l.shape[1]))
        for s, d in PK.distance_strips(x, y, metric):
            if diag:
                d[np.arange(len(d)), np.arange(s, s + len(d))] = 0.0
            sums_l[s:s + len(d)] = d @ hot_r
            if not diag:
                sums_r += d.T @ hot_l[s:s + len(d)]
        out = []
        for ids, own, sums, (which, names, hot), inner in ([(l["id"].to_numpy(), ll, sums_l, marks_r, diag)]
                                                           + ([] if diag else [(r["id"].to_numpy(), rl, sums_r, marks_l, False)])):
            i, c = np.nonzero(~np.isnan(own)[:, which])
            cnt = hot.sum(axis=0)[c] - (hot[i, c] if inner else 0)
            out.append(pd.DataFrame({"labelling": which[c], "id": ids[i], "other": names[c], "sum_d": sums[i, c], "cnt": cnt.astype(np.int64)}))
        res = pd.concat(out, ignore_index=True)
        for c in gcols:
            res.insert(0, c, g[c])
        return res[cols]

    left, right = PK.replicate(PK.assign_blocks(pts, gcols, "id", block_size), symmetric=True)
    schema = _schema(gcols, dtypes, "labelling int, id bigint, other int, sum_d double, cnt bigint")
    partial = PK.run_blocks(left, right, gcols, kernel, schema)
    own = pts.select(*gcols, F.posexplode("labels").alias("labelling", "own"), "id").where(F.col("own").isNotNull())
    per = _point_silhouettes(partial, own, [*gcols, "labelling"])
    out = _mean_silhouettes(per, [*gcols, "labelling"])
    return out if group_cols else out.drop("_g")


# ---- centroids, K2–K4 --------------------------------------------------------------------------------
def centroids(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(*group, label, size, centroid ARRAY<DOUBLE>) via per-dimension partial averages."""
    exploded = points.select(*group_cols, "label", F.posexplode("features").alias("pos", "x"))
    per_dim = exploded.groupBy(*group_cols, "label", "pos").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return per_dim.groupBy(*group_cols, "label").agg(
        F.max("n").alias("size"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def _sq(u, v):
    return F.aggregate(F.zip_with(u, v, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x)


def within_sums(points: DataFrame, cents: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per (group, label): Σ squared distance and mean distance of members to their centroid."""
    j = points.join(cents.select(*group_cols, "label", "centroid"), [*group_cols, "label"])
    sq = _sq(F.col("features"), F.col("centroid"))
    return j.groupBy(*group_cols, "label").agg(F.sum(sq).alias("wss"), F.avg(F.sqrt(sq)).alias("spread"))


def inertia(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """K4: Σ squared distance to the assigned centre (centres = label means)."""
    pts, gcols = PK.ensure_group(points, group_cols)
    w = within_sums(pts, centroids(pts, gcols), gcols)
    out = w.groupBy(*gcols).agg(F.sum("wss").alias("inertia"))
    return out if group_cols else out.drop("_g")


def calinski_harabasz(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """K3: (between / (k − 1)) / (within / (n − k)); 1.0 when within is 0; NULL when k < 2."""
    pts, gcols = PK.ensure_group(points, group_cols)
    cents = centroids(pts, gcols)
    w = within_sums(pts, cents, gcols)
    # overall mean = size-weighted mean of the centroids (no second pass over the points)
    ex = cents.select(*gcols, "size", F.posexplode("centroid").alias("pos", "x"))
    overall = (ex.groupBy(*gcols, "pos").agg((F.sum(F.col("x") * F.col("size")) / F.sum("size")).alias("x"),
                                             F.sum("size").alias("n"))
               .groupBy(*gcols).agg(F.max("n").alias("n"),
                                    F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))),
                                                lambda s: s["x"]).alias("mean")))
    b = cents.join(overall, gcols).groupBy(*gcols).agg(
        F.sum(F.col("size") * _sq(F.col("centroid"), F.col("mean"))).alias("between"),
        F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    wt = w.groupBy(*gcols).agg(F.sum("wss").alias("within"))
    j = b.join(wt, gcols)
    ch = (F.when(F.col("k") < 2, F.lit(None).cast("double"))
          .when(F.col("within") == 0, F.lit(1.0))
          .otherwise((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))))
    out = j.select(*gcols, ch.alias("calinski_harabasz"))
    return out if group_cols else out.drop("_g")


def _db_kernel(group_cols):
    def kernel(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame(columns=[*group_cols, "id", "worst"])
        g = PK.group_values(l, r, group_cols)
        d = PK.distances(PK.matrix(l), PK.matrix(r))
        sl, sr = l["spread"].to_numpy(), r["spread"].to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (sl[:, None] + sr[None, :]) / np.where(d == 0, np.inf, d)
        li, ri = l["id"].to_numpy(), r["id"].to_numpy()
        ratio[li[:, None] == ri[None, :]] = -np.inf
        out = [pd.DataFrame({"id": li, "worst": ratio.max(axis=1)}),
               pd.DataFrame({"id": ri, "worst": ratio.max(axis=0)})]
        res = pd.concat(out, ignore_index=True)
        for c in group_cols:
            res.insert(0, c, g[c])
        return res[[*group_cols, "id", "worst"]]
    return kernel


def davies_bouldin(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """K2: mean over clusters of the worst (Sᵢ + Sⱼ) / ‖cᵢ − cⱼ‖; centroid pairs go through the
    pair kernel too (only per-centroid maxima are emitted). NULL when k < 2."""
    pts, gcols = PK.ensure_group(points, group_cols)
    cents = centroids(pts, gcols)
    spread = within_sums(pts, cents, gcols)
    c = cents.join(spread, [*gcols, "label"]).select(
        *gcols, F.col("label").cast("long").alias("id"), F.col("centroid").alias("features"), "spread")
    dtypes = dict(c.dtypes)
    blocked = PK.assign_blocks(c, gcols, "id", block_size=PK.DEFAULT_BLOCK_SIZE, min_blocks=1)
    left, right = PK.replicate(blocked, symmetric=True)
    worst = PK.run_blocks(left, right, gcols, _db_kernel(gcols), _schema(gcols, dtypes, "id bigint, worst double"))
    per = worst.groupBy(*gcols, "id").agg(F.max("worst").alias("worst"))
    out = per.groupBy(*gcols).agg(
        F.when(F.count(F.lit(1)) >= 2, F.avg(F.when(F.col("worst") > F.lit(float("-inf")), F.col("worst"))
                                              .otherwise(F.lit(0.0)))).alias("davies_bouldin"))
    return out if group_cols else out.drop("_g")


# ---- F6 and cluster shape ---------------------------------------------------------------------------
def remove_small_clusters(labels: DataFrame, group_cols: Sequence[str] = (), id_col: str = "id",
                          min_size: int = MIN_CLUSTER_SIZE) -> DataFrame:
    """noise or clusters smaller than ``min_size`` → −1; survivors renumbered 0.. by first
    appearance (smallest id).  Cluster statistics are an aggregate (one row per cluster), joined back,
    so a huge cluster is never gathered into one task."""
    stats = labels.groupBy(*group_cols, "label").agg(F.count(F.lit(1)).alias("_size"), F.min(id_col).alias("_first"))
    keep = stats.where((F.col("label") != -1) & (F.col("_size") >= min_size))
    if group_cols:
        w = Window.partitionBy(*group_cols).orderBy("_first")
        renum = keep.select(*group_cols, "label", (F.dense_rank().over(w) - 1).cast("int").alias("_new"))
    else:   # one group: its clusters are numbered without a single-task window
        renum = with_positions(keep.select("label", "_first"), ["_first"], "_new").select("label", F.col("_new").cast("int").alias("_new"))
    out = labels.join(renum, [*group_cols, "label"], "left")
    return out.withColumn("label", F.coalesce(F.col("_new"), F.lit(-1)).cast("int")).drop("_new")


def cluster_lengths(labels: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """(label, size) including −1."""
    return labels.groupBy(*group_cols, "label").agg(F.count(F.lit(1)).alias("size"))


def cluster_stats(labels: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """D12 + D14: clusters, avg/min/max size (noise excluded), noise amount and fraction (2 places),
    has-noise flag, total."""
    sizes = cluster_lengths(labels, group_cols)
    clean = F.col("label") != -1
    return sizes.groupBy(*group_cols).agg(
        F.count(F.when(clean, 1)).alias("n_clusters"),
        F.bround(F.avg(F.when(clean, F.col("size"))), 2).alias("avg_cluster_size"),
        F.min(F.when(clean, F.col("size"))).alias("min_cluster_size"),
        F.max(F.when(clean, F.col("size"))).alias("max_cluster_size"),
        F.coalesce(F.sum(F.when(~clean, F.col("size"))), F.lit(0)).alias("noise_amount"),
        F.sum("size").alias("total"),
    ).withColumn("noise_fraction", F.bround(F.col("noise_amount") / F.col("total"), 2)) \
     .withColumn("has_noise", F.col("noise_amount") > 0)


def norm_stats(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """L2-norm min / max / mean per group."""
    n = F.sqrt(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x * x))
    return points.groupBy(*group_cols).agg(F.min(n).alias("norm_min"), F.max(n).alias("norm_max"),
                                           F.avg(n).alias("norm_mean"))


def standardise(points: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per-dimension mean 0 and *population* std 1; zero-variance dimensions are only centred.
    Statistics are one small row per group (arrays of length d) joined back — no regrouping of points."""
    pts, gcols = PK.ensure_group(points, group_cols)
    ex = pts.select(*gcols, F.posexplode("features").alias("pos", "x"))
    per_dim = ex.groupBy(*gcols, "pos").agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    stats = per_dim.groupBy(*gcols).agg(F.array_sort(F.collect_list(F.struct("pos", "mu", "sd"))).alias("_st"))
    j = pts.join(stats, gcols)
    scaled = F.zip_with("features", "_st", lambda x, s: F.when(s["sd"] == 0, x - s["mu"])
                        .otherwise((x - s["mu"]) / s["sd"]))
    out = j.withColumn("features", scaled).drop("_st")
    return out if group_cols else out.drop("_g")
