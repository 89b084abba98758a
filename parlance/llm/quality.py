"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 1).

One score s = w · x from hashed text features serves all grades; the thresholds t_1 < t_2 < … cut it:
P(grade ≥ j) = 1 / (1 + exp(t_j - s)).  The thresholds are kept in order by fitting the logarithms of
their distances.  The expected grade is the sum of these probabilities; P(grade ≥ keep_grade) selects.

The fit reads at most ``per_grade`` rated rows of each grade (weighted by what they stand for); scoring
reads every whole text and does not shuffle.

Cases: null or empty text has no features and is scored by the thresholds alone; it is rated like any
row.  Rows without a rating are only scored, ratings of unknown documents or null grades are not used.
Without any usable rating every document is kept, with null scores.  Repeated rows are scored one by
one; if a rating repeats, the lowest counts.  An input column with the name of a computed one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_text as H
from .common import stored

PER_GRADE = 3000
KEEP_GRADE, KEEP_AT = 1, 0.5
NEW = ["score", "expected_grade", "tail", "keep"]


@dataclass
class Model:
    weights: np.ndarray       # DIM
    thresholds: np.ndarray    # ascending, one for each grade but the lowest


def _thresholds(extra: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate((extra[:1], np.exp(extra[1:]))))


def ordinal_loss(scores, extra, y, weight):
    """Negative log-likelihood of grades y under the cumulative link, and its gradients."""
    s, t = scores[:, 0], _thresholds(extra)
    tail = 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -50, 50)))              # P(grade ≥ j), j = 1..
    full = np.concatenate((np.ones((len(s), 1)), tail, np.zeros((len(s), 1))), axis=1)
    slope = full * (1 - full)
    rows = np.arange(len(s))
    p = np.maximum(full[rows, y] - full[rows, y + 1], 1e-12)
    upper, lower = slope[rows, y] / p, slope[rows, y + 1] / p
    by_score = (-(upper - lower) * weight)[:, None]
    by_t = np.zeros(len(t) + 2)
    np.add.at(by_t, y, upper * weight)
    np.add.at(by_t, y + 1, -lower * weight)
    by_t = by_t[1:-1]
    rest = np.cumsum(by_t[::-1])[::-1]                                              # t_j holds all earlier steps
    by_extra = np.concatenate((rest[:1], rest[1:] * np.exp(extra[1:])))
    return float(-(np.log(p) * weight).sum()), by_score, by_extra


def grades_of(labels: DataFrame) -> DataFrame:
    """The graded ratings of the ``labels`` table: 0 poor, 1 sound but toxic, 2 sound and clean."""
    return (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
            .select("doc_id", F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2).alias("grade")))


def train(docs: DataFrame, ratings: DataFrame, per_grade: int = PER_GRADE, learn_from=None) -> Model | None:
    """Fit on ``ratings(doc_id, grade)``; grades may be any ascending integers from 0."""
    ratings = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    if learn_from is not None:
        ratings = ratings.where(learn_from)
    sample = stored(H.sampled(ratings, "grade", per_grade))
    top = sample.agg(F.max("grade")).first()[0]
    if not top:
        return None
    share = {r.grade: r.n for r in sample.groupBy("grade").agg(F.sum("weight").alias("n")).collect()}   # one row a grade
    total = sum(share.values())
    above = np.array([sum(n for g, n in share.items() if g >= j) / total for j in range(1, top + 1)])
    above = np.clip(above, 1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    extra = np.concatenate((start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    w, extra = H.fit(H.training_rows(docs, sample, "grade"), ordinal_loss, 1, extra)
    return Model(w[:, 0], _thresholds(extra))


def score(docs: DataFrame, model: Model | None, keep_grade: int = KEEP_GRADE, keep_at: float = KEEP_AT,
          keep_text: bool = True) -> DataFrame:
    """``docs`` with score, expected_grade, tail (P(grade ≥ keep_grade)) and keep (tail ≥ keep_at)."""
    docs = docs.drop(*[c for c in NEW if c != "text"])
    if model is None:
        none = F.lit(None).cast("double")
        out = docs.withColumns({"score": none, "expected_grade": none, "tail": none, "keep": F.lit(True)})
        return out if keep_text else out.drop("text")
    names = docs.columns
    plain = [c for c in names if keep_text or c != "text"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in plain)
    shipped = docs.sparkSession.sparkContext.broadcast(model.weights)    # DIM numbers
    thresholds = model.thresholds

    def run(batches):
        w = shipped.value
        for batch in batches:
            s = np.zeros(batch.num_rows)
            for a, x, _ in H.blocks(batch.column(names.index("text"))):
                s[a:a + len(x)] = x @ w
            tail = 1 / (1 + np.exp(np.clip(thresholds[None, :] - s[:, None], -50, 50)))
            at = tail[:, keep_grade - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in plain), pa.array(s), pa.array(tail.sum(axis=1)), pa.array(at), pa.array(at >= keep_at)],
                names=plain + NEW)
    return docs.mapInArrow(run, fields + "score double, expected_grade double, tail double, keep boolean")


def drop_poor(docs: DataFrame, model: Model | None, keep_grade: int = KEEP_GRADE, keep_at: float = KEEP_AT) -> DataFrame:
    """``docs`` without the rejected rows, columns as they were."""
    plain = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return score(plain, model, keep_grade, keep_at).where("keep").select("row.*")
