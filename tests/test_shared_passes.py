"""Several settings of DBSCAN and several labellings of the silhouette share their pair passes."""

import numpy as np
import pytest

from parlance.operators import pairs as PK
from parlance.operators import quality as Q


@pytest.fixture()
def passes(monkeypatch):
    made, run = [], PK.run_blocks
    monkeypatch.setattr(PK, "run_blocks", lambda *a, **k: made.append(1) or run(*a, **k))
    return made


def _points(spark, groups=(0, 1)):
    rng = np.random.default_rng(5)
    x = {g: np.vstack([rng.normal(c, 0.4, (25, 2)) for c in ((0, 0), (3, 0), (g + 4, 4))] + [rng.uniform(-3, 7, (15, 2))]) for g in groups}
    rows = [(g, 10 * i + 1, p.tolist()) for g, m in x.items() for i, p in enumerate(m)]
    return x, spark.createDataFrame(rows, "g int, id long, features array<double>").repartition(3)


def test_density_cuts_make_three_passes(spark, passes):
    from parlance.clustering.density import density_cuts
    from test_density import _brute_dbscan
    x, df = _points(spark)
    got = density_cuts(df, (0.3, 0.5, 0.9), 5, ["g"], block_size=16).collect()
    assert len(passes) == 3
    for g, m in x.items():
        for eps in (0.3, 0.5, 0.9):
            want, core = _brute_dbscan(m, eps, 5)
            own = sorted((r for r in got if r.g == g and r.eps == eps), key=lambda r: r.id)
            assert [r.label for r in own] == want.tolist() and [r.is_core for r in own] == core.tolist()


def test_settings_with_one_radius_and_none_of_core(spark, passes):
    from parlance.clustering.dbscan import dbscan, dbscan_many
    _, df = _points(spark, (0,))
    settings = [(0.5, 5), (0.5, 12), (0.01, 5)]
    got = dbscan_many(df.drop("g"), settings, block_size=16).collect()
    assert len(passes) == 3
    for k, (eps, ms) in enumerate(settings):
        alone = dbscan(df.drop("g"), eps, ms, block_size=16).collect()
        assert sorted((r.id, r.label, r.is_core) for r in got if r.setting == k) == sorted((r.id, r.label, r.is_core) for r in alone)
    assert {r.label for r in got if r.setting == 2} == {-1}


def test_silhouettes_of_labellings(spark, passes):
    x, df = _points(spark)
    rng = np.random.default_rng(6)
    labels = {(g, 10 * i + 1): [int(rng.integers(3)), None if i % 4 else int(rng.integers(2)), 7, None] for g, m in x.items() for i in range(len(m))}
    lab = spark.createDataFrame([(g, i, v) for (g, i), v in labels.items()], "g int, id long, labels array<int>")
    got = {(r.g, r.labelling): r.silhouette for r in Q.silhouettes(df.join(lab, ["g", "id"]), 4, ["g"], block_size=16).collect()}
    assert len(passes) == 1
    assert set(got) == {(g, k) for g in x for k in (0, 1, 2)}           # no point has a label in the last
    for k in (0, 1, 2):
        one = df.join(lab, ["g", "id"]).selectExpr("g", "id", "features", f"labels[{k}] AS label").where("label IS NOT NULL")
        for r in Q.silhouette(one, ["g"], block_size=16).collect():
            assert got[(r.g, k)] == (None if r.silhouette is None else pytest.approx(r.silhouette, rel=1e-9))


def test_k_is_chosen_by_one_pass(spark, passes):
    from parlance.clustering.kmeans import kmeans, kmeans_auto_k
    _, df = _points(spark)
    chosen, table = kmeans_auto_k(df, ["g"], (2, 3, 4), block_size=16)
    got = {(r.g, r.k): r.silhouette for r in table.collect()}
    assert len(passes) == 1 and len(got) == 6
    for k in (2, 3, 4):
        labels, _ = kmeans(df, k, ["g"])
        for r in Q.silhouette(df.join(labels, ["g", "id"]), ["g"], block_size=16).collect():
            assert got[(r.g, k)] == pytest.approx(r.silhouette, rel=1e-9)
