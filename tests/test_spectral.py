"""Spectral clustering: eigenvalues against NumPy, the distributed form against the dense one, odd groups."""

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from parlance.clustering import spectral as SP
from parlance.functions.lexicon import RANDOM_SEED


def rings(seed):
    rng = np.random.default_rng(seed)
    angle = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    near, far = [r * np.c_[np.cos(angle), np.sin(angle)] + rng.normal(scale=0.03, size=(60, 2)) for r in (1, 4)]
    return np.vstack([near, far])


def frame(spark, groups):
    rows = [(t, 3 * i + 1, p.tolist()) for t, x in groups.items() for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "tag string, id long, features array<double>").repartition(4)


def test_eigenvalues_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {"cloud": rng.normal(size=(150, 3)), "rings": rings(1), "five": rng.normal(size=(5, 2))}
    got = {r.tag: r.theta for r in SP.embedding(frame(spark, groups), ["tag"], neighbours=6, block_size=40).select("tag", "theta").distinct().collect()}
    for tag, x in groups.items():
        want = SP.dense_parts(3 * np.arange(len(x)) + 1, x, 6)[0][:4]
        assert got[tag] == pytest.approx(want.tolist(), abs=1e-6)


def test_eigenvalues_of_the_embeddings_table(spark):
    from parlance.plans.q_vectors import _pts
    pts = _pts(spark, SF).select("id", "features")
    local = sorted(pts.collect(), key=lambda r: r.id)
    want = SP.dense_parts(np.array([r.id for r in local]), np.array([r.features for r in local]))[0][:4]
    got = SP.embedding(pts).select("theta").first().theta
    assert got == pytest.approx(want.tolist(), abs=1e-6)


def test_rings_that_kmeans_cannot_part(spark):
    x = rings(2)
    label = {r.id: r.label for r in SP.spectral(frame(spark, {"r": x}).drop("tag"), ks=(2,), neighbours=6).collect()}
    mine = [label[3 * i + 1] for i in range(len(x))]
    assert len(set(mine[:60])) == 1 and len(set(mine[60:])) == 1 and mine[0] != mine[60]


def test_distributed_equals_dense(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [3, 3], [0, 4]])
    groups = {"a": np.vstack([c + rng.normal(scale=0.4, size=(20, 2)) for c in centres]),
              "b": np.vstack([c + rng.normal(scale=0.4, size=(25, 2)) for c in centres[:2]])}
    points = frame(spark, groups)
    got = SP.spectral(points, ["tag"], neighbours=59, block_size=32).collect()
    hashes = {(r.tag, r.id): r.h for r in points.select("tag", "id", F.xxhash64("id", F.lit(RANDOM_SEED)).alias("h")).collect()}
    for tag, x in groups.items():
        ids = 3 * np.arange(len(x)) + 1
        mine = [r.label for r in sorted((r for r in got if r.tag == tag), key=lambda r: r.id)]
        assert mine == SP.dense(neighbours=59)(ids, np.array([hashes[tag, i] for i in ids]), x).tolist()
        assert len(set(mine)) > 1


def test_odd_groups(spark):
    groups = {"one": np.zeros((1, 2)), "equal": np.zeros((6, 2)), "far": np.array([[0.0, 0], [0, 1], [1e4, 0], [0, 1e5]])}
    got = SP.spectral(frame(spark, groups), ["tag"]).collect()
    assert sorted((r.tag, r.id) for r in got) == sorted((t, 3 * i + 1) for t, x in groups.items() for i in range(len(x)))
    for x in groups.values():
        label = SP.dense()(np.arange(len(x)), np.arange(len(x)), x)
        assert len(label) == len(x) and (label >= 0).all()
    assert SP.spectral(frame(spark, groups).where("id < 0"), ["tag"]).count() == 0


def test_sent_block_equals_the_joined_one(spark, monkeypatch):
    """every product was a join of the edges with the block."""
    rng = np.random.default_rng(8)
    points = frame(spark, {"a": rng.normal(size=(40, 3)), "b": rings(4)[:50], "one": np.zeros((1, 3))[:, :2]})
    asked, joined = [], SP.times
    monkeypatch.setattr(SP, "times", lambda *a: asked.append(1) or joined(*a))
    sent = {(r.tag, r.id): r for r in SP.embedding(points, ["tag"], neighbours=5).collect()}
    assert not asked
    monkeypatch.setattr(SP, "SENT_NUMBERS", 0)
    rows = SP.embedding(points, ["tag"], neighbours=5).collect()
    assert asked and len(rows) == len(sent) == 91
    for r in rows:
        mine = sent[r.tag, r.id]
        assert mine.theta == pytest.approx(r.theta, abs=1e-6)
    assert len({len(r.x) for r in sent.values()}) == 1
