"""Clustering registry — name → function(points (*group, id, features), group_cols) → (*group, id, label).

Every entry clusters all groups (tag × embedder ...) in one job.  Order and defaults follow the
original registry where an algorithm is built (K-means with and without noise removal, mean-shift, affinity propagation, DBSCAN, HDBSCAN, a
density cut of the spanning tree).  Spectral clustering is built, but not an entry: the original has it switched off.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import affinity as AF
from . import dbscan as DB
from . import kmeans as KM
from . import small_groups as SG

ClusterFn = Callable[[DataFrame, Sequence[str]], DataFrame]


def _kmeans(points, group_cols, ks=(2, 3, 4, 5)):
    """K-means with k chosen per group by the exact silhouette (k in 2..5)."""
    labels, _ = KM.kmeans_auto_k(points, group_cols, ks)
    return labels.select(*group_cols, "id", "label")


def _dbscan(points, group_cols, eps=DB.DEFAULT_EPS, min_samples=DB.DEFAULT_MIN_SAMPLES):
    return DB.dbscan(points, eps, min_samples, group_cols).select(*group_cols, "id", "label")


def _kmeans_without_noise(points, group_cols):
    return KM.kmeans_without_noise(points, group_cols=group_cols)


def _density_cut(points, group_cols, min_cluster_size=5):
    from .hdbscan import mst_density_cut
    return mst_density_cut(points, min_cluster_size=min_cluster_size, group_cols=group_cols)


def _meanshift(points, group_cols):
    from .meanshift import mean_shift
    return mean_shift(points, group_cols)


def _affinity(points, group_cols):
    return AF.whole(points, group_cols).select(*group_cols, "id", "label")


def _hdbscan(points, group_cols, min_cluster_size=5):
    from .hdbscan import hdbscan
    return hdbscan(points, min_cluster_size, group_cols=group_cols)


def registry() -> dict[str, ClusterFn]:
    """Small groups are clustered by a task each, larger ones by the distributed form of the same algorithm (``small_groups.by_size``): the
    labels don't depend on the form."""
    from .hdbscan import hdbscan_small
    return {
        "K-Means": SG.by_size(SG.auto_k, _kmeans),
        "K-Means without noise": SG.by_size(SG.without_noise, _kmeans_without_noise),
        "Mean-Shift": SG.by_size(SG.mean_shift, _meanshift),
        "DBSCAN": SG.by_size(SG.density(DB.DEFAULT_EPS, DB.DEFAULT_MIN_SAMPLES), _dbscan),
        "Affinity": SG.by_size(AF.dense(), _affinity),
        "HDBSCAN": SG.by_size(hdbscan_small(), _hdbscan),
        "MST density cut": _density_cut,
    }


def names(spark) -> DataFrame:
    """The algorithm names as a frame (API listing)."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(registry())], "position int, algorithm string")
