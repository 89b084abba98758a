"""Quality, toxicity and mixing: gradients, held-out accuracy, balance of the rates, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import hashed_text, mixing, quality, toxicity
from parlance.llm import queries as Q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, score string, tail int, rate string, copies string"


def numeric(f, p, eps=1e-6):
    return np.array([(f(p + eps * e) - f(p - eps * e)) / (2 * eps) for e in np.eye(len(p))])


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    s, y, w = rng.normal(size=(7, 1)), np.array([0, 1, 2, 3, 3, 0, 2]), rng.random(7) + 0.5
    extra = np.array([-0.5, 0.1, -0.7])
    _, by_score, by_extra = quality.ordinal_loss(s, extra, y, w)
    assert np.allclose(by_extra, numeric(lambda e: quality.ordinal_loss(s, e, y, w)[0], extra), atol=1e-5)
    assert np.allclose(by_score[:, 0], numeric(lambda v: quality.ordinal_loss(v[:, None], extra, y, w)[0], s[:, 0]), atol=1e-5)
    assert (np.diff(quality._thresholds(extra)) > 0).all()


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"a", b"The cat, the cat.", "Éa 12 été".encode(), b"x" * 5000, b"\n\n"]
    all_at_once, words = hashed_text.counts(texts)
    for t, row, n in zip(texts, all_at_once, words):
        alone, m = hashed_text.counts([t])
        assert np.allclose(alone[0], row) and m[0] == n == len(t.split())


def graded(n=240):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        g = i % 3
        w = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(60)]
        t = " | ".join(w).upper() if g == 0 else " ".join(x + ("!!" if k % 3 == 0 and g == 1 else "") for k, x in enumerate(w))
        rows.append((i, t, "x", 1, "r", "c"))
    return rows


def test_ordinal_regression_orders_grades(spark):
    rows = graded()
    docs = spark.createDataFrame(rows + [(500, None, "", 0, "", ""), (501, "", "", 0, "", ""), (None, "abc", "", 0, "", ""), rows[0]], DOCS)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(150)] + [(None, 1), (3, None), (9999, 2), (4, 1)], "doc_id bigint, grade int")
    model = quality.train(docs, ratings)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + 4
    mean = [np.mean([r.expected_grade for r in got if r.doc_id is not None and 150 <= r.doc_id < 500 and r.doc_id % 3 == g]) for g in range(3)]
    assert mean[0] < 0.5 < mean[1] < 1.5 < mean[2]
    left = quality.drop_poor(docs, model)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert not {i for i in range(150, 240) if i % 3 == 0} & ids and {i for i in range(150, 240) if i % 3} <= ids
    assert quality.train(docs, ratings.limit(0)) is None
    assert quality.score(docs, None).where("keep").count() == len(rows) + 4
    assert quality.score(docs.limit(0), model).count() == 0


def test_toxicity_held_out(spark):
    rng = random.Random(7)
    syllables = ["the", "on", "er", "an", "re", "in", "ed", "nd", "ha", "ou", "ti", "es"]
    bad = ["wretchling", "gorblax", "fnardle", "skumbu"]
    rows, labels = [], []
    for i in range(1500):
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 80))]
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    docs = spark.createDataFrame(rows + [(5000, None), (5001, ""), (None, "gorblax"), rows[0]], "doc_id bigint, text string")
    lab = spark.createDataFrame(labels + [(None, 1), (7777, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, lab)).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    hit = sum(p and y for p, y in held)
    assert 2 * hit / (sum(p for p, _ in held) + sum(y for _, y in held)) > 0.9
    none = toxicity.score(docs, toxicity.train(docs, lab.where("toxic = 0")))
    assert none.where("score = 0 AND predicted = 0").count() == len(rows) + 4


def test_labels_of_held_out_documents_do_not_count(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(hashed_text.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, x)).collect()} for x in (labels, flipped))
    assert a == b


def test_rates_meet_targets(spark):
    rows = []
    for i in range(200):
        d = "ab"[i % 5 == 0]
        rows.append((i, " ".join(("kappa " if d == "a" else "zulu ") + str(k) for k in range(5 + i % 7)), "", 0, "", ""))
    docs = spark.createDataFrame(rows + [(900, None, "", 0, "", ""), (901, "", "", 0, "", "")], DOCS)
    labelled = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(100)] + [(None, "a"), (5, None), (6, "unknown")], "doc_id bigint, domain string")
    targets = {"a": 0.3, "b": 0.7, "absent": 0.5}
    got = mixing.mix(docs, labelled, targets).collect()
    total = sum(r.n_tokens for r in got)
    share = sum(r.rate * r.n_tokens * np.array(r.posteriors) for r in got) / total
    assert np.allclose(share, [0.3, 0.7], atol=1e-3) and min(r.rate for r in got) >= 0
    assert all(abs(r.copies - r.rate) <= 1 for r in got) and len(got) == 202
    assert {r.rate for r in mixing.mix(docs, labelled.limit(0), targets).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labelled, targets).count() == 0


def test_replay_is_projected_gradient():
    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 40)
    t = rng.integers(1, 50, 40) / 1000
    b = np.array([0.6, 0.25, 0.15])
    m = np.linalg.inv((p * t[:, None]).T @ p / t.sum())
    r, steps, loss = np.ones(40), [], []
    for _ in range(60):
        gap = (t * r) @ p / t.sum() - b
        loss.append(gap @ m @ gap)
        steps.append(m @ gap)
        r = np.maximum(0, r - p @ steps[-1])
        assert np.allclose(r, mixing.replay(p, steps)[0])
    assert all(y <= x + 1e-12 for x, y in zip(loss, loss[1:])) and loss[-1] < 1e-8


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_every_query_runs(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.count() > 0
