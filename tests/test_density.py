import numpy as np
import pytest

from parlance.clustering.dbscan import dbscan
from parlance.clustering.hdbscan import mst
from parlance.operators import graph
from parlance.operators.neighbours import knn


def _blobs(seed=3, n=80):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0], [5, 5], [0, 6]])
    x = np.vstack([c + rng.normal(scale=0.6, size=(n // 4, 2)) for c in centres] + [rng.uniform(-3, 8, size=(n - 3 * (n // 4), 2))])
    return x


def _brute_dbscan(x, eps, ms):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = (d <= eps).sum(1) >= ms
    comp = -np.ones(len(x), int)
    for i in np.where(core)[0]:
        if comp[i] != -1:
            continue
        stack, comp[i] = [i], i
        while stack:
            u = stack.pop()
            for v in np.where((d[u] <= eps) & core & (comp == -1))[0]:
                comp[v] = i
                stack.append(v)
    firsts = sorted({comp[i] for i in np.where(core)[0]})
    num = {c: k for k, c in enumerate(firsts)}
    lab = np.array([num[comp[i]] if core[i] else -1 for i in range(len(x))])
    for i in np.where(~core)[0]:
        adj = [lab[j] for j in np.where((d[i] <= eps) & core)[0]]
        if adj:
            lab[i] = min(adj)
    return lab, core


def test_dbscan_matches_brute_force(spark):
    x = _blobs()
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "id long, features array<double>")
    got = dbscan(df, 0.8, 5, block_size=16).orderBy("id").collect()
    want, core = _brute_dbscan(x, 0.8, 5)
    assert [r["label"] for r in got] == want.tolist()
    assert [r["is_core"] for r in got] == core.tolist()


def test_components_chain(spark):
    v = spark.createDataFrame([(i,) for i in range(10)], "id long")
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 4)] + [(6, 7), (9, 8)], "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.connected_components(v, e).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8}


def test_mst_weight_equals_prim(spark):
    x = _blobs(seed=5, n=40)
    ms = 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, ms - 1]
    mrd = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    n = len(x)
    seen, best, total = np.zeros(n, bool), np.full(n, np.inf), 0.0
    best[0] = 0
    for _ in range(n):
        i = int(np.argmin(np.where(seen, np.inf, best)))
        seen[i] = True
        total += best[i]
        best = np.minimum(best, mrd[i])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, features array<double>")
    edges = mst(df, ms, block_size=8).collect()
    assert len(edges) == n - 1
    assert sum(r["w"] for r in edges) == pytest.approx(total, rel=1e-9)


def test_knn_excludes_self(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [3.0])], "id long, features array<double>")
    got = {(r["id"], r["neighbour"]) for r in knn(df, k=1, block_size=1).collect()}
    assert got == {(0, 1), (1, 0), (2, 1)}


def test_mean_shift_finds_blobs(spark):
    from parlance.clustering.meanshift import mean_shift
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, 0.2, size=(15, 2)) for c in ([0, 0], [6, 0], [0, 6])])
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x))], "id long, features array<double>")
    got = {r["id"]: r["label"] for r in mean_shift(df, bandwidth=1.5, block_size=16).collect()}
    groups = [{got[i] for i in range(k * 15, (k + 1) * 15)} for k in range(3)]
    assert all(len(g) == 1 for g in groups)
    assert len(set.union(*groups)) == 3


def test_nearest_place_matches_brute_force(spark):
    from parlance.operators.geo import EARTH_RADIUS_KM, nearest_place
    rng = np.random.default_rng(4)
    pts = [(i, float(rng.uniform(-80, 80)), float(rng.uniform(-180, 180))) for i in range(300)]
    places = [(j, float(rng.uniform(-85, 85)), float(rng.uniform(-180, 180))) for j in range(30)]

    def hav(a, b):
        p1, p2 = np.radians(a[0]), np.radians(b[0])
        dphi, dl = p2 - p1, np.radians(b[1] - a[1])
        h = np.sin(dphi / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
        return 2 * EARTH_RADIUS_KM * np.arcsin(min(1.0, np.sqrt(h)))
    want = {}
    for i, la, lo in pts:
        best = min(((hav((la, lo), (pla, plo)), j) for j, pla, plo in places), default=None)
        if best and best[0] <= 1500:
            want[i] = best[1]
    p = spark.createDataFrame(pts, "pid long, lat double, lon double")
    q = spark.createDataFrame(places, "place_id long, lat double, lon double")
    got = {r["pid"]: r["place_id"] for r in nearest_place(p, q, 1500.0).collect()}
    assert got == want


def test_mst_with_ties_and_large_ids(spark):
    """Grid points have many equal distances; ids lie above 2^31."""
    base = 1 << 40
    pts = [(base + 10 * i + j, [float(i), float(j)]) for i in range(5) for j in range(5)]
    df = spark.createDataFrame(pts, "id long, features array<double>")
    from parlance.clustering.hdbscan import mst_density_cut
    edges = mst(df, 2, block_size=6).collect()
    assert len(edges) == 24 and abs(sum(e.w for e in edges) - 24.0) < 1e-9
    labels = mst_density_cut(df, min_cluster_size=3, cut_distance=1.0, block_size=6).collect()
    assert {r.label for r in labels} == {0}


def test_cosine_of_a_zero_vector_is_one():
    import numpy as np
    from parlance.operators.pairs import distances
    d = distances(np.array([[0.0, 0.0], [1.0, 0.0]]), np.array([[0.0, 0.0], [0.0, 2.0]]), "cosine")
    assert d.tolist() == [[1.0, 1.0], [1.0, 1.0]]


def test_bandwidth_in_few_passes(spark, monkeypatch):
    from parlance.clustering import meanshift as MS
    rng = np.random.default_rng(11)
    x = {g: rng.normal(size=(n, 3)) for g, n in ((0, 60), (1, 3), (2, 1))}
    x[0][:20] = x[0][0]
    df = spark.createDataFrame([(g, i, v.tolist()) for g, m in x.items() for i, v in enumerate(m)], "g int, id long, features array<double>")
    passes, cross = [], MS._cross
    monkeypatch.setattr(MS, "_cross", lambda *a: passes.append(1) or cross(*a))
    got = {r["g"]: r["bandwidth"] for r in MS.estimate_bandwidth(df, ["g"], block_size=16).collect()}
    for g, m in x.items():
        d = np.sort(np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1)), axis=1)
        assert abs(got[g] - d[:, max(1, int(0.3 * len(m))) - 1].mean()) < 1e-9
    assert len(passes) <= 7


def test_radius_counts_are_those_of_the_distances(monkeypatch):
    """the bandwidth took all distances in difference form and sorted them, seven times."""
    from parlance.clustering import meanshift as MS
    from parlance.operators import pairs as PK
    rng = np.random.default_rng(7)
    for n, m, d, offset in ((80, 120, 16, 0), (40, 50, 2, 0), (30, 50, 3, 1e6), (60, 90, 1, 0)):
        x, y = rng.normal(size=(n, d)) + offset, rng.normal(size=(m, d)) + offset
        x, y = (np.round(x * 8) / 8, np.round(y * 8) / 8) if d == 1 else (x, np.vstack([y, x[:5]]))
        dist = PK.distances(x, y)
        third = np.quantile(dist, 0.3, axis=1)
        for lo, hi in ((np.zeros(n), np.full(n, 8.0)), (third, 1.02 * third), (third, third * (1 + 1e-12))):
            radii = lo[:, None] + (hi - lo)[:, None] * (np.arange(1, MS.PARTS) / MS.PARTS)
            want = (dist[:, None, :] <= radii[:, :, None]).sum(axis=2)
            assert (MS._radius_counts(x, y, lo, hi) == want).all()
    # without the difference form of every pair
    asked, pair = [], PK.pair_distances
    monkeypatch.setattr(PK, "pair_distances", lambda a, b, i, j: asked.append(len(i)) or pair(a, b, i, j))
    monkeypatch.setattr(PK, "distances", lambda *a: 1 / 0)
    x, y = rng.normal(size=(100, 16)), rng.normal(size=(300, 16))
    MS._radius_counts(x, y, np.full(100, 4.0), np.full(100, 4.5))
    assert sum(asked) < 300
