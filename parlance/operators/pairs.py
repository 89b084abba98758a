"""Blocked pair kernel: all-pairs distance work without materialising pairs.

Points of a group are hashed into ``B`` blocks (B grows with the group, so a
group holding a third of all rows is split like any other).  Each point is
replicated to the ``B + 1`` block pairs ``(bi <= bj)`` it takes part in, and
one grouped ``applyInPandas`` call per block pair runs a NumPy kernel.  A
kernel never returns the pairs themselves, only what the operator needs:
per-point sums per label (silhouette), the k smallest distances (k-NN),
neighbour counts within eps, a spanning forest of eps-edges, or per-point
minima.  Work per task is bounded by ``block_size²``; shuffle volume by
``n · (B + 1)`` points.

A kernel walks its block pair in strips of rows.  Euclidean distances come from a matrix product first
(``squared``), with a bound on its rounding; whatever the bound can't decide (a distance at a limit, the
candidates of a k-th place, cancelled digits) is computed again in difference form, so results are those of
``distances``.
"""

from __future__ import annotations

import math
from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK_SIZE = 2048    # of kernels that hold a whole block pair of distances
WIDE_BLOCK_SIZE = 8192       # of kernels that hold a strip of it: a quarter of the copies of each point
_CHUNK_ELEMS = 1 << 16  # elements per difference tensor chunk (512 kB: stays in the cache)
_STRIP_ELEMS = 1 << 21  # distances of a strip
_PAIR_CHUNK = 1 << 12   # pairs per chunk of single pairs in difference form


def _parallelism(df: DataFrame) -> int:
    try:
        return int(df.sparkSession.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return 8


def ensure_group(points: DataFrame, group_cols: Sequence[str]):
    """A constant group column when the caller has none (one global group)."""
    if group_cols:
        return points, list(group_cols)
    return points.withColumn("_g", F.lit(0)), ["_g"]


def assign_blocks(points: DataFrame, group_cols: Sequence[str], id_col: str,
                  block_size: int = DEFAULT_BLOCK_SIZE, min_blocks: int | None = None) -> DataFrame:
    """Add ``_nb`` (blocks of the group) and ``_b`` (block of the point).

    A group gets at least ceil(n / block_size) blocks (bounded work per task) and, for parallelism,
    a share of the cores proportional to its size: about sqrt(2 · P · n / N) blocks, i.e. ~P · n / N
    block pairs.  One big group is spread over all cores; many small groups get one block each."""
    counts = points.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"))
    if min_blocks is None:
        par = _parallelism(points)
        total = counts.agg(F.sum("_n").alias("_all")).withColumn("_one", F.lit(1))     # one row
        counts = counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").drop("_one")
        share = F.ceil(F.sqrt(2.0 * par * F.col("_n") / F.col("_all")))
    else:
        share = F.lit(min_blocks)
    nb = F.least(F.col("_n"), F.greatest(F.ceil(F.col("_n") / block_size), share)).cast("int")
    counts = counts.select(*group_cols, nb.alias("_nb"))
    joined = points.join(counts, list(group_cols))
    return joined.withColumn("_b", F.pmod(F.xxhash64(F.col(id_col)), F.col("_nb")).cast("int"))


def replicate(blocked: DataFrame, symmetric: bool = True):
    """Left and right replicas keyed by (bi, bj); symmetric → only bi <= bj."""
    if symmetric:
        left = blocked.withColumn("_bi", F.col("_b")).withColumn(
            "_bj", F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)))
        # the diagonal pair (bi = bj) only needs one copy: the kernel reads its left side
        right = blocked.withColumn("_bj", F.col("_b")).withColumn(
            "_bi", F.explode(F.sequence(F.lit(0), F.col("_b")))).where(F.col("_bi") < F.col("_bj"))
    else:
        left = blocked.withColumn("_bi", F.col("_b")).withColumn(
            "_bj", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        right = blocked.withColumn("_bj", F.col("_b")).withColumn(
            "_bi", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return left.drop("_b", "_nb"), right.drop("_b", "_nb")


def run_blocks(left: DataFrame, right: DataFrame, group_cols: Sequence[str],
               kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """One grouped ``applyInPandas`` per block pair; the two roles travel in one frame
    (``_side``), which keeps both replicas in the same exchange."""
    keys = [*group_cols, "_bi", "_bj"]
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["_side"].to_numpy()
        lft = pdf[side == 0].reset_index(drop=True)
        rgt = pdf[side == 1].reset_index(drop=True)
        if len(lft) == 0:
            lft, rgt = rgt, lft
        if len(rgt) == 0 and int(pdf["_bi"].iloc[0]) == int(pdf["_bj"].iloc[0]):
            rgt = lft
        return kernel(lft, rgt)

    return both.groupBy(*keys).applyInPandas(call, schema)


# ---- NumPy helpers used inside the kernels -------------------------------------------------------
def matrix(pdf: pd.DataFrame, col: str = "features") -> np.ndarray:
    if len(pdf) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in pdf[col].values])


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Exact pair distances in difference form (chunked), or cosine distance."""
    if len(a) == 0 or len(b) == 0:
        return np.zeros((len(a), len(b)))
    if metric == "cosine":
        # a zero vector is at distance 1 from everything
        an = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), np.finfo(float).tiny)
        bn = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), np.finfo(float).tiny)
        return np.clip(1.0 - an @ bn.T, 0.0, 2.0)
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric}")
    out = np.empty((len(a), len(b)))
    step = max(1, _CHUNK_ELEMS // max(1, len(b) * a.shape[1]))
    for s in range(0, len(a), step):
        diff = a[s:s + step, None, :] - b[None, :, :]
        out[s:s + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact euclidean distances of the rows i of a to the rows j of b, pair by pair."""
    out = np.empty(len(i))
    for s in range(0, len(i), _PAIR_CHUNK):
        diff = a[i[s:s + _PAIR_CHUNK]] - b[j[s:s + _PAIR_CHUNK]]
        out[s:s + _PAIR_CHUNK] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def strips(n: int, m: int):
    """(first, end) of the rows of each strip of an n × m block pair."""
    step = max(1, _STRIP_ELEMS // max(1, m))
    return [(s, min(n, s + step)) for s in range(0, n, step)]


def norms(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)


def rounding(na: np.ndarray, nb: np.ndarray, dims: int) -> float:
    """A bound on the error of ``squared`` for squared norms up to these (not finite: the product form is of no use)."""
    with np.errstate(over="ignore", invalid="ignore"):
        return float(4 * (dims + 16) * np.finfo(float).eps * (na.max(initial=0.0) + nb.max(initial=0.0)))


def squared(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Squared distances by the matrix product, within ``rounding`` of the exact ones."""
    out = a @ b.T
    out *= -2.0
    out += na[:, None]
    out += nb[None, :]
    return out


def within(a: np.ndarray, b: np.ndarray, limit, metric: str = "euclidean"):
    """(first row, mask) of each strip of ``distances(a, b) <= limit``; ``limit`` is a number or has one a row."""
    for s, (mask,) in within_many(a, b, [limit], metric):
        yield s, mask


def within_many(a: np.ndarray, b: np.ndarray, limits: Sequence, metric: str = "euclidean"):
    """(first row, masks) of each strip, a mask for each limit as in ``within``: the distances are computed once."""
    limits = [np.broadcast_to(np.asarray(x, dtype=np.float64), (len(a),)) for x in limits]
    na, nb = (norms(a), norms(b)) if metric == "euclidean" else (np.zeros(1), np.zeros(1))
    slack = rounding(na, nb, a.shape[1])
    for s, e in strips(len(a), len(b)):
        if metric != "euclidean" or not np.isfinite(slack):
            d = distances(a[s:e], b, metric)
            yield s, [d <= limit[s:e, None] for limit in limits]
            continue
        sq, exact, masks = squared(a[s:e], b, na[s:e], nb), None, []
        for limit in limits:
            lim = limit[s:e, None]
            lim2 = np.where(lim >= 0, lim * lim, -np.inf)
            near = slack + 8 * np.finfo(float).eps * np.where(lim >= 0, lim2, 0.0)
            mask = sq <= lim2 + near
            i, j = np.nonzero(mask & (sq >= lim2 - near))       # too near the limit to tell
            if 8 * len(i) > sq.size:
                exact = distances(a[s:e], b) if exact is None else exact
                mask = exact <= lim
            elif len(i):
                mask[i, j] = pair_distances(a[s:e], b, i, j) <= limit[s:e][i]
            masks.append(mask)
        yield s, masks


def distance_strips(a: np.ndarray, b: np.ndarray, metric: str = "euclidean"):
    """(first row, distances) of each strip, for sums: relative error about 1e-12, equal points at exactly 0."""
    na, nb = (norms(a), norms(b)) if metric == "euclidean" else (np.zeros(1), np.zeros(1))
    finite = np.isfinite(rounding(na, nb, a.shape[1]))
    for s, e in strips(len(a), len(b)):
        if metric != "euclidean" or not finite:
            yield s, distances(a[s:e], b, metric)
            continue
        sq = squared(a[s:e], b, na[s:e], nb)
        # few digits are left of a small difference of large squares
        i, j = np.nonzero(sq <= 1e-3 * (na[s:e].max(initial=0.0) + nb.max(initial=0.0)))
        if 8 * len(i) > sq.size:
            yield s, distances(a[s:e], b)
            continue
        np.sqrt(np.maximum(sq, 0.0, out=sq), out=sq)
        if len(i):
            sq[i, j] = pair_distances(a[s:e], b, i, j)
        yield s, sq


def nearest(a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, k: int, metric: str = "euclidean"):
    """(row, id, distance) of the k rows of ``b`` nearest to each row of ``a`` that have another id, ties by the smaller id."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    order = np.argsort(ids_b, kind="stable")
    b, ids_b = np.ascontiguousarray(b[order]), ids_b[order]
    # of equal points only the first can be among the k nearest (one id, that of the row itself, may be left out)
    _, group = np.unique(b.view(np.dtype((np.void, b.dtype.itemsize * max(1, b.shape[1])))).ravel(), return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    first = np.searchsorted(group[by_group], group[by_group])
    most = np.unique(ids_b, return_counts=True)[1].max()
    keep = np.sort(by_group[np.arange(len(b)) - first < k + most])
    b, ids_b = b[keep], ids_b[keep]
    na, nb = (norms(a), norms(b)) if metric == "euclidean" else (np.zeros(1), np.zeros(1))
    slack = rounding(na, nb, a.shape[1])
    product = metric == "euclidean" and np.isfinite(slack)
    rows, names, found = [], [], []
    for s, e in strips(len(a), len(b)):
        d = squared(a[s:e], b, na[s:e], nb) if product else distances(a[s:e], b, metric)
        lo, hi = np.searchsorted(ids_b, ids_a[s:e], "left"), np.searchsorted(ids_b, ids_a[s:e], "right")
        for r in np.flatnonzero(hi > lo):
            d[r, lo[r]:hi[r]] = np.inf
        kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(e - s, np.inf)
        bound = kth + (4 * slack if product else 0.0)
        i, j = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
        dist = pair_distances(a[s:e], b, i, j) if product else d[i, j]
        sel = np.lexsort((ids_b[j], dist, i))
        i, j, dist = i[sel], j[sel], dist[sel]
        ok = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(dist)
        rows.append(i[ok] + s), names.append(ids_b[j[ok]]), found.append(dist[ok])
    return np.concatenate(rows), np.concatenate(names), np.concatenate(found)


def group_values(pdf_l: pd.DataFrame, pdf_r: pd.DataFrame, group_cols: Sequence[str]) -> dict:
    src = pdf_l if len(pdf_l) else pdf_r
    return {c: src[c].iloc[0] for c in group_cols}


def same_block(pdf_l: pd.DataFrame, pdf_r: pd.DataFrame) -> bool:
    src = pdf_l if len(pdf_l) else pdf_r
    return int(src["_bi"].iloc[0]) == int(src["_bj"].iloc[0]) and pdf_l is pdf_r
