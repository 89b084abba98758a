import numpy as np
import pytest

from parlance.operators import quality as Q

PTS = [(0, [0.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0),
       (3, [10.0, 10.0], 1), (4, [10.0, 11.0], 1), (5, [11.0, 10.0], 1)]


@pytest.fixture
def six(spark):
    return spark.createDataFrame(PTS, "id long, features array<double>, label int")


def test_metrics_golden(six):
    assert Q.silhouette(six, block_size=2).first()["silhouette"] == pytest.approx(0.9196222281154851, abs=1e-12)
    assert Q.davies_bouldin(six).first()["davies_bouldin"] == pytest.approx(0.09249505911485287, abs=1e-12)
    assert Q.calinski_harabasz(six).first()["calinski_harabasz"] == pytest.approx(450.0, abs=1e-9)
    assert Q.inertia(six).first()["inertia"] == pytest.approx(2.6666666666666667, abs=1e-12)


def _numpy_silhouette(x, lab):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_across_blocks_and_groups(spark):
    rng = np.random.default_rng(7)
    rows = []
    want = {}
    for g in range(2):
        x = rng.normal(size=(60, 5))
        lab = rng.integers(0, 3, size=60)
        lab[0] = 7  # a singleton cluster
        want[g] = _numpy_silhouette(x, lab)
        rows += [(g, i, x[i].tolist(), int(lab[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "g int, id long, features array<double>, label int")
    got = {r["g"]: r["silhouette"] for r in Q.silhouette(df, ["g"], block_size=8).collect()}
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-12)


def test_small_cluster_removal_and_stats(spark):
    labels = [3, 3, 3, 3, 7, -1, 0, 0, 0, 0, 0]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(labels)], "id long, label int")
    out = Q.remove_small_clusters(df)
    assert [r["label"] for r in out.orderBy("id").collect()] == [0, 0, 0, 0, -1, -1, 1, 1, 1, 1, 1]
    st = Q.cluster_stats(out).first()
    assert (st["n_clusters"], st["avg_cluster_size"], st["min_cluster_size"], st["max_cluster_size"]) == (2, 4.5, 4, 5)
    assert (st["noise_amount"], st["noise_fraction"], st["has_noise"]) == (2, 0.18, True)


def test_standardise_population_std(spark):
    df = spark.createDataFrame([(0, [1.0, 5.0]), (1, [3.0, 5.0])], "id long, features array<double>")
    got = sorted(tuple(r["features"]) for r in Q.standardise(df).collect())
    assert got == [(-1.0, 0.0), (1.0, 0.0)]
