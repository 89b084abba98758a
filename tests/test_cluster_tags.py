import pytest
from pyspark.sql import functions as F

from parlance.plans import cluster_tags as CT


def _points(spark):
    rows = [("weekly", t, "e", 100 * k + i, [float(i % 2) * 9 + 0.01 * i, float(k)], f"alpha beta w{i % 3}")
            for k, t in enumerate(("t1", "t2")) for i in range(12)]
    return spark.createDataFrame(rows, "frequency string, tag string, embedder string, id long, features array<double>, text string")


def test_a_failed_algorithm_becomes_a_row(spark, monkeypatch):
    def broken(points, group_cols):
        raise ValueError("no such thing")

    def by_side(points, group_cols):
        return points.select(*group_cols, "id", (F.col("features")[0] > 5).cast("int").alias("label"))
    monkeypatch.setattr(CT, "cluster_registry", lambda: {"Good": by_side, "Broken": broken})
    df = _points(spark)
    points, corpus = df.drop("text"), df.select("frequency", "tag", "id", "text")
    labels, runs = CT.cluster_all(points, ["Good", "Broken"])
    mood = corpus.select("frequency", "tag", "id", F.lit(0.25).alias("sentiment"))
    got = {(r.tag, r.algorithm): r for r in CT.result_rows(points, labels, corpus, mood, "weekly", runs)["rows"].collect()}
    assert len(got) == 4
    for t in ("t1", "t2"):
        good, bad = got[t, "Good"], got[t, "Broken"]
        assert good.success and good.n_clusters == 2 and good.time >= 0 and good.sil_score > 0.9
        assert set(good.themes) == {0, 1} and good.themes[0][0] == "Alpha beta" and good.sentiment == {0: 0.25, 1: 0.25}
        assert not bad.success and bad.time == -1 and bad.n_clusters is None and bad.tweets == 12
    # what has a row is not computed again
    done = spark.createDataFrame([("weekly", "t1", "e", "Good")], "frequency string, tag string, embedder string, algorithm string")
    again, _ = CT.cluster_all(points, ["Good"], done)
    assert {r.tag for r in again.collect()} == {"t2"}


def test_p2_runs_every_registered_combination(spark, monkeypatch):
    from parlance.clustering.registry import registry
    from parlance.plans import q_clusters

    class Asked(Exception):
        pass

    def asked(spark, sf_dir, **names):
        raise Asked(names)
    monkeypatch.setattr(CT, "cluster_tags", asked)
    with pytest.raises(Asked) as e:
        q_clusters.p2_cluster_tags(spark, "none")
    names = e.value.args[0]
    assert tuple(names["embedders"]) == tuple(CT.embedder_factories(None)) and tuple(names["algorithms"]) == tuple(registry())
