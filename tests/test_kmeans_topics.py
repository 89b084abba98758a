"""P7's report: scores, first members and the topics of every model within each cluster."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.operators import quality as Q
from parlance.plans import q_more as M


def test_every_step_is_in_the_report(spark):
    """scores and first members were missing, and LDA stood for all models of the topics."""
    rng = np.random.default_rng(1)
    words = [["red", "green", "blue", "sun", "moon", "star"], ["cat", "dog", "bird", "fish", "fox", "wolf"]]
    rows, points, labels = [], [], []
    for i in range(24):
        c = i % 2
        x = rng.normal(size=3) + 8 * c
        rows.append((i // 3 * 3, " ".join(rng.choice(words[c], 4)), i))         # ids repeat
        points.append((i, x.tolist()))
        labels.append((i, c, float((x ** 2).sum())))
    rows.append((99, "alone", 24)), points.append((24, [90.0, 0.0, 0.0])), labels.append((24, 7, 0.5))
    corpus = spark.createDataFrame(rows, "id long, text string, row long")
    vec = spark.createDataFrame(points, "id long, features array<double>")
    found = spark.createDataFrame(labels, "id long, label int, sqdist double")
    got = M.kmeans_topics(corpus, vec, found, ("NMF", "PLSI", "LDA")).collect()
    score = Q.silhouette(vec.join(found, "id")).first()["silhouette"]
    for c, members in ((0, range(0, 24, 2)), (1, range(1, 24, 2))):
        own = [r for r in got if r.cluster == c]
        assert {(r.model, r.topic) for r in own} == {(m, t) for m in ("NMF", "PLSI", "LDA") for t in range(10)}
        assert {r.size for r in own} == {12} and {tuple(r.first_members) for r in own} == {tuple(sorted(i // 3 * 3 for i in members))}
        assert {r.term for r in own} <= set(words[c])
        assert all(r.silhouette == pytest.approx(score) and r.inertia == pytest.approx(sum(x[2] for x in labels)) for r in own)
    rest = [r for r in got if r.cluster == 7]
    assert len(rest) == 1 and rest[0].first_members == [99] and rest[0].model is None and rest[0].silhouette == pytest.approx(score)
