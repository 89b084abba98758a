"""Pruned neighbour search: the rows of brute force, ties and small groups included, and what is skipped."""

import numpy as np
import pytest

from parlance.operators import pruned as PR


def brute(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = []
    for i in range(len(x)):
        others = sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i)[:k]
        rows += [(ids[i], r + 1, n, v) for r, (v, n) in enumerate(others)]
    return rows


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(scale=20, size=(6, 3))
    groups = {"blobs": np.vstack([c + rng.normal(size=(40, 3)) for c in centres]), "grid": np.array([[a, b, 0.0] for a in range(7) for b in range(7)]),
              "copies": np.vstack([np.zeros((30, 3)), np.ones((5, 3))]), "two": np.eye(3)[:2], "one": np.zeros((1, 3))}
    rows = [(t, 7 * i + 3, p.tolist()) for t, x in groups.items() for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "tag string, id long, features array<double>").repartition(3)
    got = PR.knn_pruned(df, 4, ["tag"], pivots=6, block_size=16).collect()
    for t, x in groups.items():
        want = brute(x, [7 * i + 3 for i in range(len(x))], 4)
        mine = sorted((r.id, r.rank, r.neighbour, r.distance) for r in got if r.tag == t)
        assert [m[:3] for m in mine] == [w[:3] for w in want]
        assert [m[3] for m in mine] == pytest.approx([w[3] for w in want])
    told = {r.tag: r for r in PR.report(df, 4, ["tag"], pivots=6, block_size=16).collect()}
    assert told["blobs"].skipped > told["blobs"].visits and told["one"].visits == 0
    assert all(r.skipped >= 0 for r in told.values())
    assert PR.knn_pruned(df.where("id < 0"), 2, ["tag"]).count() == 0


def test_without_groups(spark):
    x = np.random.default_rng(1).normal(size=(60, 2))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, features array<double>")
    got = sorted((r.id, r.rank, r.neighbour) for r in PR.knn_pruned(df, 2, pivots=4, block_size=20).collect())
    assert got == [w[:3] for w in brute(x, list(range(60)), 2)]
