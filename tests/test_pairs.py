import numpy as np

from parlance.operators import neighbours as NB
from parlance.operators import pairs as PK


def _points(n=200, dims=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + 1000.0             # far from the origin: the product form loses digits
    return np.vstack([x, x[:40], np.repeat(x[:1], 30, axis=0)])


def test_mask_is_exact_at_the_limit(monkeypatch):
    monkeypatch.setattr(PK, "_STRIP_ELEMS", 1 << 12)
    x = _points()
    d = PK.distances(x, x)
    for limit in (0.0, -1.0, float(d[0, 7]), float(np.nextafter(d[0, 7], 0)), 2.0):
        seen = list(PK.within(x, x, limit))
        assert len(seen) > 1 and all(m.size <= 1 << 12 for _, m in seen)     # never a whole block pair
        assert (np.vstack([m for _, m in seen]) == (d <= limit)).all()
    rows = d[:, 3]
    assert (np.vstack([m for _, m in PK.within(x, x, rows)]) == (d <= rows[:, None])).all()


def test_distances_for_sums():
    x = _points()
    got = np.vstack([m for _, m in PK.distance_strips(x, x)])
    want = PK.distances(x, x)
    assert np.allclose(got, want, rtol=1e-9, atol=0) and (got[want == 0] == 0).all()


def test_nearest_takes_the_smaller_id_on_ties(monkeypatch):
    monkeypatch.setattr(PK, "_STRIP_ELEMS", 1 << 12)
    x = _points()
    ids = np.random.default_rng(5).permutation(len(x)) // 2          # every id twice
    d = PK.distances(x, x)
    for k in (1, 3, len(x)):
        row, other, dist = PK.nearest(x, x, ids, ids, k)
        for r in range(len(x)):
            order = np.lexsort((ids, d[r]))
            order = order[ids[order] != ids[r]][:k]
            assert other[row == r].tolist() == ids[order].tolist() and dist[row == r].tolist() == d[r][order].tolist()


def test_knn_among_many_copies(spark):
    copies = [(int(i), [1.0, 2.0, 3.0]) for i in np.random.default_rng(6).permutation(600)]
    df = spark.createDataFrame(copies + [(1000 + i, [float(i), 0.0, 0.0]) for i in range(50)], "id long, features array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in NB.knn(df, 2).where("id < 600").collect()}
    assert got == {(i, r): ([v for v in (0, 1, 2) if v != i])[r - 1] for i in range(600) for r in (1, 2)}


def test_forest_by_strips_equals_components(monkeypatch):
    monkeypatch.setattr(PK, "_STRIP_ELEMS", 1 << 10)
    rng = np.random.default_rng(7)
    x, ids = rng.uniform(size=(300, 2)), rng.permutation(300) + 5
    src, dst = NB._forest(ids, ids, PK.within(x, x, 0.05))
    near = PK.distances(x, x) <= 0.05
    lab = ids.copy()
    while True:
        new = np.array([lab[near[i]].min() for i in range(len(ids))])
        if (new == lab).all():
            break
        lab = new
    assert dict(zip(src, dst)) == {i: c for i, c in zip(ids, lab) if i != c}
