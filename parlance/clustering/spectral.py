"""J11 spectral clustering: leading eigenvectors of the normalised affinity of a neighbour graph, then k-means on their rows.

The affinity of two points is exp(−gamma · squared distance) where one is among the ``neighbours`` nearest of the other (no loops); with
neighbours = n − 1 it is the whole affinity matrix.  M = D^−½ W D^−½ has its eigenvalues in [−1, 1]; the largest belong to the smallest of
the Laplacian I − M.  A block of ``BLOCK`` vectors a group, one array a point, goes through rounds of

* a Chebyshev filter of degree ``DEGREE`` that damps [−1, the block's smallest Ritz value]: products with M, each a join of the edges with
  the block and a partial sum a point, chained in one plan, so that the edges are shuffled once a round;
* Rayleigh–Ritz: the block's Gram matrices are one summed row a group, solved by group, and the rotation is joined back.

A block of up to ``SENT_NUMBERS`` numbers goes through the same rounds on the driver, only M lies with the tasks: a product sends them the block and
brings its image back (``_sent_eigenvectors``).

Rounds end when the residuals |Mx − θx| of the wanted vectors are below ``tol``, or at ``max_rounds`` with a warning.  The rows of the first k
vectors, divided by the root of the degree, are clustered for every k of ``ks`` at once, and the k of the highest silhouette of the points
themselves is kept (the smallest on ties).

Cases: a group of one point is one cluster; a point whose affinities are all 0 has degree 0 and a row of 0 in M.  If the
k-th eigenvalue is (nearly) equal to the next, the vectors of that value are any basis of theirs, and labels can depend on it.
"""

from __future__ import annotations

import pickle
import warnings
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import RANDOM_SEED
from ..operators import neighbours as NB
from ..operators import pairs as PK
from ..operators.order import with_positions
from ..session import cut_lineage, release
from . import kmeans as KM
from . import small_groups as SG

NEIGHBOURS, GAMMA, KS = 10, 1.0, (2, 3, 4)
BLOCK, DEGREE, MAX_ROUNDS, TOL = 16, 8, 60, 1e-4
SENT_NUMBERS = 1 << 24       # of a block that is sent to the tasks in every product: 128 MB
STRIP_ROWS = 1 << 15         # rows of M that lie together
DEPENDENT = 1e-10            # of a normalised Gram matrix: a direction below is not independent of the others


def graph(points: DataFrame, group_cols: Sequence[str] = (), neighbours: int = NEIGHBOURS, gamma: float = GAMMA,
          block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """(*group, i, j, w): the affinities, both directions of every edge."""
    g = list(group_cols)
    near = NB.knn(points, neighbours, g, block_size=block_size).select(
        *g, F.col("id").alias("i"), F.col("neighbour").alias("j"), F.exp(-gamma * F.col("distance") * F.col("distance")).alias("w"))
    both = near.select(*g, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e"), "w")
    return both.groupBy(*g, "e.i", "e.j").agg(F.max("w").alias("w"))


def normalised(edges: DataFrame, points: DataFrame, group_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(M as (*group, i, j, m) with m ≠ 0, the degrees (*group, id, degree) of all points)."""
    g = list(group_cols)
    sums = edges.groupBy(*g, F.col("i").alias("id")).agg(F.sum("w").alias("degree"))
    degrees = cut_lineage(points.select(*g, "id").join(sums, [*g, "id"], "left").fillna(0.0, ["degree"]))
    root = degrees.where("degree > 0").select(*g, "id", F.sqrt("degree").alias("d"))
    m = (edges.join(root.select(*g, F.col("id").alias("i"), F.col("d").alias("di")), [*g, "i"])
         .join(root.select(*g, F.col("id").alias("j"), F.col("d").alias("dj")), [*g, "j"])
         .select(*g, "i", "j", (F.col("w") / F.col("di") / F.col("dj")).alias("m")))
    return m.where("m > 0"), degrees


def with_own(m: DataFrame, degrees: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """M with a row (i, i, 0) for every point: what carries a point's own arrays through ``times``."""
    return m.unionByName(degrees.select(*group_cols, F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("m")))


def times(m: DataFrame, state: DataFrame, column: str, out: str, group_cols: Sequence[str]) -> DataFrame:
    """``state`` (*group, id, ...) with ``out`` = M · ``column``; ``m`` from ``with_own``.  The state is read once, so that a chain of
    products is a chain of joins, and comes out partitioned by the key that the next join needs."""
    g = list(group_cols)
    others = [c for c in state.columns if c not in (*g, "id")]
    parts = m.join(state.withColumnRenamed("id", "j"), [*g, "j"]).select(
        *g, F.col("i").alias("id"), array_to_vector(F.transform(column, lambda v: v * F.col("m"))).alias("_v"),
        *[F.when(F.col("i") == F.col("j"), F.col(c)).alias(c) for c in others])
    return parts.groupBy(*g, "id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in others],
                                       vector_to_array(Summarizer.sum(F.col("_v"))).alias(out))


def _outer(a: str, b: str) -> Column:
    return F.flatten(F.transform(a, lambda u: F.transform(b, lambda v: u * v)))


def ritz(sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, Ritz values, residuals), highest first, from the summed YᵀY, YᵀMY and (MY)ᵀMY; columns of a dependent block are 0."""
    gram, h, s = sums.reshape(3, size, size)
    scale = np.sqrt(np.maximum(np.diag(gram), np.finfo(float).tiny))
    value, vector = np.linalg.eigh(gram / scale[:, None] / scale[None, :])
    own = value > DEPENDENT
    basis = vector[:, own] / np.sqrt(value[own]) / scale[:, None]
    t = basis.T @ ((h + h.T) / 2) @ basis
    theta, u = np.linalg.eigh((t + t.T) / 2)
    theta, r = theta[::-1], (basis @ u)[:, ::-1]
    rest = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", r, s, r) - theta ** 2, 0))
    rotation, values, residuals = np.zeros((size, size)), np.full(size, -1.0), np.zeros(size)
    k = len(theta)
    rotation[:, :k], values[:k], residuals[:k] = r, theta, rest
    return rotation, values, residuals


def _rotations(state: DataFrame, g: list, size: int) -> DataFrame:
    """(*group, rot, theta, rest) from the block ``y`` and its product ``my``: one row a group."""
    flat = F.concat(_outer("y", "y"), _outer("y", "my"), _outer("my", "my"))
    sums = state.select(*g, array_to_vector(flat).alias("_v")).groupBy(*g).agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("sums"))
    kinds = dict(state.dtypes)

    def solve(batches):
        for pdf in batches:
            solved = [ritz(np.asarray(x), size) for x in pdf["sums"]]
            yield pd.DataFrame({**{c: pdf[c] for c in g}, "rot": [r.T.ravel().tolist() for r, _, _ in solved],
                                "theta": [t.tolist() for _, t, _ in solved], "rest": [e.tolist() for _, _, e in solved]})
    schema = "".join(f"`{c}` {kinds[c]}, " for c in g) + "rot array<double>, theta array<double>, rest array<double>"
    return sums.mapInPandas(solve, schema)


def eigenvectors(m: DataFrame, degrees: DataFrame, group_cols: Sequence[str], wanted: int = max(KS), size: int = BLOCK, degree: int = DEGREE,
                 max_rounds: int = MAX_ROUNDS, tol: float = TOL, seed: int = RANDOM_SEED) -> DataFrame:
    """(*group, id, x array of the ``wanted`` leading eigenvectors' entries, theta array of their eigenvalues)."""
    g = list(group_cols)
    if degrees.count() * size <= SENT_NUMBERS:
        return _sent_eigenvectors(m, degrees, g, wanted, size, degree, max_rounds, tol, seed)
    m = cut_lineage(with_own(m, degrees, g))
    # the root of the degrees is the leading vector of a connected graph; the others begin with hashes of the id
    start = F.array(F.sqrt("degree"), *[F.xxhash64(F.col("id"), F.lit(seed + c)) / F.lit(2.0 ** 63) for c in range(1, size)])
    state = cut_lineage(times(m, degrees.select(*g, "id", start.alias("y")), "y", "my", g))
    turns = cut_lineage(_rotations(state, g, size))
    for _ in range(max_rounds):
        worst = turns.agg(F.max(F.array_max(F.slice("rest", 1, wanted)))).first()[0]
        if worst is None or worst <= tol:
            break
        rotated = _turn(state, turns, g, size)
        cut = F.greatest(F.element_at("theta", -1), F.lit(-0.5))
        block = rotated.select(*g, "id", F.col("x").alias("t0"), (2 / (1 + cut)).alias("p"), ((1 - cut) / (1 + cut)).alias("q"))
        block = times(m, block, "t0", "mt", g).select(
            *g, "id", "p", "q", "t0", F.zip_with("mt", "t0", lambda u, v: F.col("p") * u + F.col("q") * v).alias("t1"))
        for _ in range(degree - 1):
            step = F.zip_with(F.zip_with("mt", "t1", lambda u, v: 2 * (F.col("p") * u + F.col("q") * v)), "t0", lambda u, v: u - v)
            block = times(m, block, "t1", "mt", g).select(*g, "id", "p", "q", F.col("t1").alias("t0"), step.alias("t1"))
        before = (state, turns)
        state = cut_lineage(times(m, block.select(*g, "id", F.col("t1").alias("y")), "y", "my", g))
        turns = cut_lineage(_rotations(state, g, size))
        release(*before)
    else:
        warnings.warn(f"spectral: residuals above {tol} after {max_rounds} rounds")
    return _turn(state, turns, g, size).select(*g, "id", F.slice("x", 1, wanted).alias("x"), F.slice("theta", 1, wanted).alias("theta"))


def _sent_eigenvectors(m: DataFrame, degrees: DataFrame, g: list, wanted: int, size: int, degree: int, max_rounds: int, tol: float, seed: int) -> DataFrame:
    """The rounds of ``eigenvectors`` with the block on the driver; an id of several rows is one row of the block."""
    spark = degrees.sparkSession
    sc = spark.sparkContext
    start = F.array(F.sqrt("degree"), *[F.xxhash64(F.col("id"), F.lit(seed + c)) / F.lit(2.0 ** 63) for c in range(1, size)])
    rows = degrees.dropna(subset=[*g, "id"]).groupBy(*g, "id").agg(F.first("degree").alias("degree"), F.count(F.lit(1)).cast("double").alias("_c"))
    rows = cut_lineage(with_positions(rows, [*g, "id"], "_p"))
    at = sorted((r["_lo"], r["_n"]) for r in rows.groupBy(*g).agg(F.min("_p").alias("_lo"), F.count(F.lit(1)).alias("_n")).collect())
    n = sum(k for _, k in at)

    def packed(batches):
        for pdf in batches:
            yield pd.DataFrame({"p": [pdf["_p"].to_numpy(np.int64).tobytes()], "c": [pdf["_c"].to_numpy(float).tobytes()],
                                "y": [np.array(pdf["y"].tolist(), float).tobytes()]})
    block, times_ = np.zeros((n, size)), np.zeros(n)
    for r in rows.select("_p", "_c", start.alias("y")).mapInPandas(packed, "p binary, c binary, y binary").toLocalIterator():
        p = np.frombuffer(r["p"], np.int64)
        block[p], times_[p] = np.frombuffer(r["y"]).reshape(-1, size), np.frombuffer(r["c"])
    own = max(1, min(STRIP_ROWS, -(-n // (2 * sc.defaultParallelism))))
    place = rows.select(*g, "id", "_p")
    entries = (m.join(place.withColumnsRenamed({"id": "i", "_p": "_r"}), [*g, "i"]).join(place.withColumnsRenamed({"id": "j", "_p": "_k"}), [*g, "j"])
               .select(F.floor(F.col("_r") / own).alias("_s"), "_r", "_k", "m"))

    def strip(key, pdf):
        pdf = pdf.sort_values(["_r", "_k"], kind="stable")
        first = int(key[0]) * own
        part = (first, min(own, n - first), (pdf["_r"].to_numpy() - first).astype(np.int32), pdf["_k"].to_numpy(np.int64), pdf["m"].to_numpy(float))
        return pd.DataFrame({"strip": [pickle.dumps(part, protocol=5)]})
    strips = (entries.groupBy("_s").applyInPandas(strip, "strip binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK))

    def product(x: np.ndarray) -> np.ndarray:
        sent, out = sc.broadcast(np.ascontiguousarray(x.T)), np.zeros(x.shape)

        def image(part):
            first, length, row, col, value = part
            return first, np.stack([np.bincount(row, value * column[col], length) for column in sent.value], axis=1)
        for first, found in strips.map(image).collect():
            out[first:first + len(found)] = found
        sent.destroy()
        return out

    def turns():
        out = []
        for lo, k in at:
            y, my = block[lo:lo + k], moved[lo:lo + k]
            out.append(ritz(np.concatenate([(y.T @ y).ravel(), (y.T @ my).ravel(), (my.T @ my).ravel()]), size))
        return out
    moved = product(block * times_[:, None])
    solved = turns()
    for _ in range(max_rounds):
        if not at or max(rest[:wanted].max() for _, _, rest in solved) <= tol:
            break
        t0, p, q = np.empty((n, size)), np.empty((n, 1)), np.empty((n, 1))
        for (lo, k), (rotation, theta, _) in zip(at, solved):
            cut = max(theta[-1], -0.5)
            t0[lo:lo + k], p[lo:lo + k], q[lo:lo + k] = block[lo:lo + k] @ rotation, 2 / (1 + cut), (1 - cut) / (1 + cut)
        t1 = p * product(t0) + q * t0
        for _ in range(degree - 1):
            t0, t1 = t1, 2 * (p * product(t1) + q * t1) - t0
        block = t1
        moved = product(block)
        solved = turns()
    else:
        warnings.warn(f"spectral: residuals above {tol} after {max_rounds} rounds")
    strips.unpersist()
    starts = np.array([lo for lo, _ in at], np.int64)
    vectors = np.empty((n, min(wanted, size)))
    for (lo, k), (rotation, _, _) in zip(at, solved):
        vectors[lo:lo + k] = (block[lo:lo + k] @ rotation)[:, :wanted]
    sent = sc.broadcast((vectors, [theta[:wanted].tolist() for _, theta, _ in solved]))

    def named(batches):
        vectors, thetas = sent.value
        for pdf in batches:
            p = pdf.pop("_p").to_numpy(np.int64)
            yield pdf.assign(x=list(vectors[p]), theta=[thetas[k] for k in np.searchsorted(starts, p, "right") - 1])
    kinds = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in g) + f"id {kinds['id']}, x array<double>, theta array<double>"
    out = cut_lineage(rows.select(*g, "id", "_p").mapInPandas(named, schema))
    sent.destroy()
    release(rows)
    return out


def _turn(state: DataFrame, turns: DataFrame, g: list, size: int) -> DataFrame:
    column = lambda c: F.aggregate(F.zip_with("y", F.slice("rot", c * size + 1, size), lambda u, v: u * v),
                                   F.lit(0.0), lambda acc, v: acc + v)
    return (state.join(turns, g).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), column))
            .select(*g, "id", "x", "theta"))


def embedding(points: DataFrame, group_cols: Sequence[str] = (), wanted: int = max(KS), neighbours: int = NEIGHBOURS, gamma: float = GAMMA,
              block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """(*group, id, x, theta): a point's row of the leading vectors, divided by the root of its degree."""
    pts, g = PK.ensure_group(points.select(*group_cols, "id", "features"), group_cols)
    m, degrees = normalised(cut_lineage(graph(pts, g, neighbours, gamma, block_size)), pts, g)
    root = degrees.select(*g, "id", F.sqrt(F.when(F.col("degree") > 0, F.col("degree")).otherwise(1.0)).alias("_d"))
    out = (eigenvectors(m, degrees, g, wanted, size=max(BLOCK, wanted + 4)).join(root, [*g, "id"])
           .select(*g, "id", F.transform("x", lambda v: v / F.col("_d")).alias("x"), "theta"))
    return out if group_cols else out.drop("_g")


def spectral(points: DataFrame, group_cols: Sequence[str] = (), ks: Sequence[int] = KS, neighbours: int = NEIGHBOURS, gamma: float = GAMMA,
             seed: int = RANDOM_SEED, block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """(*group, id, label), the best k of ``ks`` by the silhouette of the points."""
    from ..operators.quality import silhouettes
    pts, g = PK.ensure_group(points.select(*group_cols, "id", "features"), group_cols)
    pts, ks = cut_lineage(pts), [int(k) for k in ks]
    rows = cut_lineage(embedding(pts, g, max(ks), neighbours, gamma, block_size))
    multi = rows.select(*g, "id", "x", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    labels, _ = KM.kmeans(multi.select(*g, "k", "id", F.slice("x", 1, F.col("k")).alias("features")), "k", [*g, "k"], seed)
    labels = cut_lineage(labels.select(*g, "k", "id", "label"))
    # one row a point with its labels for all k: the silhouettes share one pair pass
    nth = Window.partitionBy(*g, "k", "id").orderBy("label")
    own = (labels.withColumn("_r", F.row_number().over(nth)).groupBy(*g, "id", "_r")
           .agg(F.array(*[F.max(F.when(F.col("k") == k, F.col("label"))) for k in ks]).alias("labels")).drop("_r"))
    scores = silhouettes(pts.join(own, [*g, "id"]), len(ks), g, block_size=block_size)
    scores = scores.select(*g, F.array(*[F.lit(k) for k in ks])[F.col("labelling")].alias("k"), "silhouette")
    first = Window.partitionBy(*g).orderBy(F.desc_nulls_last("silhouette"), "k")          # a row a k
    best = scores.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(*g, "k")
    out = labels.join(best, [*g, "k"]).select(*g, "id", F.col("label").cast("int"))
    return out if group_cols else out.drop("_g")


def dense_parts(ids: np.ndarray, x: np.ndarray, neighbours: int = NEIGHBOURS, gamma: float = GAMMA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, highest first; the vectors divided by the roots of the degrees; the distances) from the whole matrix."""
    n, d = len(ids), PK.distances(x, x)
    w, off = np.zeros((n, n)), d + np.where(np.eye(n, dtype=bool), np.inf, 0)
    for i in range(n):
        near = np.lexsort((ids, off[i]))[:min(neighbours, n - 1)]
        w[i, near] = np.exp(-gamma * d[i, near] ** 2)
    w = np.maximum(w, w.T)
    degree = w.sum(axis=1)
    root = np.sqrt(np.where(degree > 0, degree, 1))
    value, vector = np.linalg.eigh(w / root[:, None] / root[None, :])
    return value[::-1], vector[:, ::-1] / root[:, None], d


def dense(ks: Sequence[int] = KS, neighbours: int = NEIGHBOURS, gamma: float = GAMMA):
    """The kernel of ``small_groups``."""
    def run(ids, hashes, x):
        if len(ids) == 1:
            return np.zeros(1, int)
        _, rows, d = dense_parts(ids, x, neighbours, gamma)
        best, found = None, None
        for k in sorted(ks):
            label, _ = SG.lloyd(ids, hashes, rows[:, :k], k)
            score = SG.silhouette(d, label)
            if found is None or (score is not None and (best is None or score > best)):
                best, found = score, label
        return found
    return run
