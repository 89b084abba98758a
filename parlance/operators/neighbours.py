"""Neighbour operators on the pair kernel: C9 k-NN, C10 eps-range, F7 sorted k-NN curve, and the
per-point reductions the density algorithms need (neighbour counts, eps spanning forests,
lowest adjacent label)."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pairs as PK


def _schema(gcols, dtypes, extra):
    return ", ".join([f"{c} {dtypes[c]}" for c in gcols] + [extra])


def _frame(g, gcols, cols: dict) -> pd.DataFrame:
    res = pd.DataFrame(cols)
    for c in reversed(gcols):
        res.insert(0, c, g[c])
    return res


def _pairs_setup(points, group_cols, block_size, cols=("id", "features")):
    pts, gcols = PK.ensure_group(points.select(*group_cols, *cols), group_cols)
    dtypes = dict(pts.dtypes)
    blocked = PK.assign_blocks(pts, gcols, "id", block_size)
    return pts, gcols, dtypes, blocked


def _sides(l, r):
    """Whether the pair is one block, and ids and matrices of both sides (the same points on the diagonal)."""
    diag = PK.same_block(l, r)
    li, x = l["id"].to_numpy(), PK.matrix(l)
    return (diag, li, li, x, x) if diag else (diag, li, r["id"].to_numpy(), x, PK.matrix(r))


# ---- C9 k nearest neighbours -------------------------------------------------------------------
def knn(points: DataFrame, k: int = 1, group_cols: Sequence[str] = (), metric: str = "euclidean",
        block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """(*group, id, rank, neighbour, distance) for the k nearest *other* points.
    Each block pair emits at most k candidates per point; the final top-k per point is a
    bounded window (≤ k · blocks rows per point)."""
    pts, gcols, dtypes, blocked = _pairs_setup(points, group_cols, block_size)

    def kernel(l, r):
        cols = [*gcols, "id", "neighbour", "distance"]
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame(columns=cols)
        g = PK.group_values(l, r, gcols)
        diag, li, ri, x, y = _sides(l, r)
        outs = []
        for ids, others, p, q in ((li, ri, x, y),) if diag else ((li, ri, x, y), (ri, li, y, x)):
            row, neighbour, dist = PK.nearest(p, q, ids, others, k, metric)
            outs.append(_frame(g, gcols, {"id": ids[row], "neighbour": neighbour, "distance": dist}))
        return pd.concat(outs, ignore_index=True)[cols]

    left, right = PK.replicate(blocked, symmetric=True)
    cand = PK.run_blocks(left, right, gcols, kernel, _schema(gcols, dtypes, "id bigint, neighbour bigint, distance double"))
    w = Window.partitionBy(*gcols, "id").orderBy("distance", "neighbour")
    out = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = out.select(*gcols, "id", F.col("rank").cast("int"), "neighbour", "distance")
    return out if group_cols else out.drop("_g")


def sorted_curve(dist: DataFrame, value_col: str = "distance") -> DataFrame:
    """values sorted ascending with their 0-based position (range partitions + per-partition
    offsets — no single-partition window)."""
    from .order import with_positions
    # equal values (every exact duplicate has 0) are spread by a second key
    keyed = dist.select(value_col, F.monotonically_increasing_id().alias("_key"))
    return with_positions(keyed, [value_col, "_key"]).select("position", value_col)


def _mask_pairs(strips, li, ri):
    """Places of the pairs of different ids in the strips of a mask."""
    rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, mask in strips:
        i, j = np.nonzero(mask)
        ok = li[i + s] != ri[j]
        rows.append(i[ok] + s), cols.append(j[ok])
    return np.concatenate(rows), np.concatenate(cols)


# ---- C10 pairs within eps, and the counts / forests DBSCAN needs ----------------------------------------
def range_pairs(points: DataFrame, eps: float, group_cols: Sequence[str] = (), metric: str = "euclidean",
                block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """Every pair (id < other) with distance <= eps — the join result itself."""
    pts, gcols, dtypes, blocked = _pairs_setup(points, group_cols, block_size)

    def kernel(l, r):
        cols = [*gcols, "id", "other", "distance"]
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame(columns=cols)
        g = PK.group_values(l, r, gcols)
        diag, li, ri, x, y = _sides(l, r)
        i, j = _mask_pairs(PK.within(x, y, eps, metric), li, ri)
        if diag:
            i, j = i[i < j], j[i < j]
        dist = PK.pair_distances(x, y, i, j) if metric == "euclidean" else PK.distances(x, y, metric)[i, j]
        return _frame(g, gcols, {"id": np.minimum(li[i], ri[j]), "other": np.maximum(li[i], ri[j]), "distance": dist})[cols]

    left, right = PK.replicate(blocked, symmetric=True)
    out = PK.run_blocks(left, right, gcols, kernel, _schema(gcols, dtypes, "id bigint, other bigint, distance double"))
    out = out.dropDuplicates([*gcols, "id", "other"])
    return out if group_cols else out.drop("_g")


def neighbour_counts(points: DataFrame, eps: float, group_cols: Sequence[str] = (), metric: str = "euclidean",
                     block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """Number of points within eps of each point, the point itself included."""
    return neighbour_counts_many(points, [eps], group_cols, metric, block_size).withColumn("neighbours", F.element_at("neighbours", 1))


def neighbour_counts_many(points: DataFrame, eps: Sequence[float], group_cols: Sequence[str] = (), metric: str = "euclidean",
                          block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """``neighbour_counts`` of several radii by one pair pass; ``neighbours`` is an array in the order of ``eps``."""
    pts, gcols, dtypes, blocked = _pairs_setup(points, group_cols, block_size)
    eps, names = list(eps), [f"c{k}" for k in range(len(eps))]

    def kernel(l, r):
        cols = [*gcols, "id", *names]
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame(columns=cols)
        g = PK.group_values(l, r, gcols)
        diag, li, ri, x, y = _sides(l, r)
        of_l, of_r = np.zeros((len(eps), len(li)), np.int64), np.zeros((len(eps), len(ri)), np.int64)
        for s, masks in PK.within_many(x, y, eps, metric):
            for k, m in enumerate(masks):
                of_l[k, s:s + len(m)] = m.sum(axis=1)
                if not diag:
                    of_r[k] += m.sum(axis=0)
        ids, counts = (li, of_l) if diag else (np.concatenate([li, ri]), np.concatenate([of_l, of_r], axis=1))
        return _frame(g, gcols, {"id": ids, **dict(zip(names, counts))})[cols]

    left, right = PK.replicate(blocked, symmetric=True)
    part = PK.run_blocks(left, right, gcols, kernel, _schema(gcols, dtypes, ", ".join(["id bigint", *[f"{c} bigint" for c in names]])))
    out = part.groupBy(*gcols, "id").agg(F.array(*[F.sum(c) for c in names]).alias("neighbours"))
    return out if group_cols else out.drop("_g")


class _Forest:
    """Star edges (node → smallest node of its component) of a graph inside one block pair, of the masks added to it."""

    def __init__(self, li, ri):
        self.nodes, pos = np.unique(np.concatenate([li, ri]), return_inverse=True)
        self.pl, self.pr = pos[:len(li)], pos[len(li):]
        self.lab = np.arange(len(self.nodes))

    def add(self, rows, mask, at=None, cols=None):
        """``mask`` of the left rows ``rows`` against all right ones (they are the rows ``at`` and columns ``cols`` of it)."""
        at, cols = np.arange(len(mask)) if at is None else at, np.arange(mask.shape[1]) if cols is None else cols
        lab, pl, us, vs = self.lab, self.pl[rows], [], []
        of_row, of_col = lab[pl], lab[self.pr]
        most = np.bincount(of_col).argmax()
        # pairs of one component already tell nothing new: rows of the largest one need the columns outside it only
        for r, c in ((np.flatnonzero(of_row == most), np.flatnonzero(of_col != most)), (np.flatnonzero(of_row != most), np.arange(len(of_col)))):
            if len(r) and len(c):
                i, j = np.nonzero(mask[np.ix_(at[r], cols[c])] & (of_row[r][:, None] != of_col[c][None, :]))
                us.append(pl[r[i]]), vs.append(self.pr[c[j]])
        u, v = np.concatenate([np.zeros(0, np.int64), *us]), np.concatenate([np.zeros(0, np.int64), *vs])
        while len(u):  # the larger root takes the smaller label, then pointers are jumped; vectorised
            m = np.minimum(lab[u], lab[v])
            np.minimum.at(lab, lab[u], m)
            np.minimum.at(lab, lab[v], m)
            while not np.array_equal(lab, lab[lab]):
                lab = lab[lab]
            apart = lab[u] != lab[v]
            u, v = u[apart], v[apart]
        self.lab = lab

    def edges(self):
        keep = np.flatnonzero(self.lab != np.arange(len(self.nodes)))
        return self.nodes[keep], self.nodes[self.lab[keep]]


def _forest(li, ri, strips):
    """Star edges of the graph of the mask's ``strips`` inside one block pair."""
    forest = _Forest(li, ri)
    for s, mask in strips:
        forest.add(np.arange(s, s + len(mask)), mask)
    return forest.edges()


def eps_forests(points: DataFrame, eps: Sequence[float], group_cols: Sequence[str] = (), metric: str = "euclidean",
                block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """``eps_forest`` for several radii by one pair pass: edges (*group, setting, src, dst), a setting an entry of ``eps``.  ``member``, an
    array of booleans, says in which settings a point takes part."""
    pts, gcols, dtypes, blocked = _pairs_setup(points, group_cols, block_size, ("id", "features", "member"))
    radii = sorted(set(eps))

    def kernel(l, r):
        cols = [*gcols, "setting", "src", "dst"]
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame(columns=cols)
        g = PK.group_values(l, r, gcols)
        diag, li, ri, x, y = _sides(l, r)
        in_l = np.stack(l["member"].to_numpy())
        in_r = in_l if diag else np.stack(r["member"].to_numpy())
        right = [np.flatnonzero(in_r[:, k]) for k in range(len(eps))]
        forests = [_Forest(li[in_l[:, k]], ri[right[k]]) for k in range(len(eps))]
        before = np.vstack([np.zeros(len(eps), np.int64), np.cumsum(in_l, axis=0)])
        for s, masks in PK.within_many(x, y, radii, metric):
            for k, e in enumerate(eps):
                m = masks[radii.index(e)]
                rows = np.flatnonzero(in_l[s:s + len(m), k])
                if len(rows) and len(right[k]):
                    forests[k].add(before[s, k] + np.arange(len(rows)), m, rows, right[k])
        found = [f.edges() for f in forests]
        return _frame(g, gcols, {"setting": np.repeat(np.arange(len(eps), dtype=np.int32), [len(s) for s, _ in found]),
                                 "src": np.concatenate([s for s, _ in found]), "dst": np.concatenate([t for _, t in found])})[cols]

    left, right = PK.replicate(blocked, symmetric=True)
    out = PK.run_blocks(left, right, gcols, kernel, _schema(gcols, dtypes, "setting int, src bigint, dst bigint"))
    return out if group_cols else out.drop("_g")


def lowest_adjacent_labels(points: DataFrame, eps: Sequence[float], group_cols: Sequence[str] = (), metric: str = "euclidean",
                           block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """``lowest_adjacent_label`` for several radii by one pair pass: (*group, setting, id, label).  ``labels``, an array of int, has a point's
    label in each setting; points of label −1 are the ones asked for."""
    pts, gcols, dtypes, blocked = _pairs_setup(points, group_cols, block_size, ("id", "features", "labels"))
    radii = sorted(set(eps))

    def kernel(l, r):
        cols = [*gcols, "setting", "id", "label"]
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame(columns=cols)
        g = PK.group_values(l, r, gcols)
        diag, li, ri, x, y = _sides(l, r)
        lab_l = np.stack(l["labels"].to_numpy())
        lab_r = lab_l if diag else np.stack(r["labels"].to_numpy())
        outs, none = [], np.int32(np.iinfo(np.int32).max)
        for ids, p, q, own, other in ((li, x, y, lab_l, lab_r),) if diag else ((li, x, y, lab_l, lab_r), (ri, y, x, lab_r, lab_l)):
            asked = np.flatnonzero((own < 0).any(axis=1))
            of = [np.flatnonzero(other[:, k] >= 0) for k in range(len(eps))]
            if not len(asked) or not any(len(c) for c in of):
                continue
            # labels rise from left to right: the first hit is the lowest
            of = [c[np.argsort(other[c, k], kind="stable")] for k, c in enumerate(of)]
            best = np.full((len(eps), len(asked)), none, np.int32)
            for s, masks in PK.within_many(p[asked], q, radii, metric):
                for k, e in enumerate(eps):
                    m = masks[radii.index(e)]
                    rows = np.flatnonzero(own[asked[s:s + len(m)], k] < 0)
                    if len(rows) and len(of[k]):
                        hit = m[np.ix_(rows, of[k])]
                        first = hit.argmax(axis=1)
                        best[k, s + rows] = np.where(hit[np.arange(len(rows)), first], other[of[k][first], k], none)
            k, i = np.nonzero(best < none)
            outs.append(_frame(g, gcols, {"setting": k.astype(np.int32), "id": ids[asked[i]], "label": best[k, i]}))
        return pd.concat(outs, ignore_index=True)[cols] if outs else pd.DataFrame(columns=cols)

    left, right = PK.replicate(blocked, symmetric=True)
    part = PK.run_blocks(left, right, gcols, kernel, _schema(gcols, dtypes, "setting int, id bigint, label int"))
    out = part.groupBy(*gcols, "setting", "id").agg(F.min("label").alias("label"))
    return out if group_cols else out.drop("_g")


def eps_forest(points: DataFrame, eps: float, group_cols: Sequence[str] = (), metric: str = "euclidean",
               block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """Edges (src, dst) of a spanning forest of the eps-graph: each block pair emits at most one
    edge per point it touches, so the output is O(n · blocks) even when eps-neighbourhoods are dense;
    the connected components are those of the full eps-graph."""
    pts, gcols, dtypes, blocked = _pairs_setup(points, group_cols, block_size)

    def kernel(l, r):
        cols = [*gcols, "src", "dst"]
        if len(l) == 0 or len(r) == 0:
            return pd.DataFrame(columns=cols)
        g = PK.group_values(l, r, gcols)
        _, li, ri, x, y = _sides(l, r)
        s, t = _forest(li, ri, PK.within(x, y, eps, metric))
        return _frame(g, gcols, {"src": s, "dst": t})[cols]

    left, right = PK.replicate(blocked, symmetric=True)
    out = PK.run_blocks(left, right, gcols, kernel, _schema(gcols, dtypes, "src bigint, dst bigint"))
    return out if group_cols else out.drop("_g")


def lowest_adjacent_label(queries: DataFrame, labelled: DataFrame, eps: float, group_cols: Sequence[str] = (),
                          metric: str = "euclidean", block_size: int = PK.WIDE_BLOCK_SIZE) -> DataFrame:
    """For each query point, the smallest ``label`` among labelled points within eps (asymmetric pairs)."""
    q = queries.select(*group_cols, "id", "features").withColumn("label", F.lit(-1)).withColumn("_role", F.lit(0))
    lab = labelled.select(*group_cols, "id", "features", F.col("label").cast("int")).withColumn("_role", F.lit(1))
    both, gcols = PK.ensure_group(q.unionByName(lab), group_cols)
    dtypes = dict(both.dtypes)
    blocked = PK.assign_blocks(both, gcols, "id", block_size)
    left, right = PK.replicate(blocked, symmetric=False)
    left = left.where(F.col("_role") == 0)
    right = right.where(F.col("_role") == 1)

    def kernel(l, r):
        cols = [*gcols, "id", "label"]
        if len(l) == 0 or len(r) == 0 or l is r or (l["_role"] != 0).any():
            return pd.DataFrame(columns=cols)
        g = PK.group_values(l, r, gcols)
        labels, none = r["label"].to_numpy().astype(np.int32), np.int32(np.iinfo(np.int32).max)
        best = np.full(len(l), none, np.int32)
        for s, m in PK.within(PK.matrix(l), PK.matrix(r), eps, metric):
            best[s:s + len(m)] = np.where(m, labels[None, :], none).min(axis=1)
        ok = best < np.iinfo(np.int32).max
        return _frame(g, gcols, {"id": l["id"].to_numpy()[ok], "label": best[ok].astype(np.int32)})[cols]

    part = PK.run_blocks(left, right, gcols, kernel, _schema(gcols, dtypes, "id bigint, label int"))
    out = part.groupBy(*gcols, "id").agg(F.min("label").alias("label"))
    return out if group_cols else out.drop("_g")
