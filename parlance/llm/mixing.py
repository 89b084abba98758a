"""Mixing documents to target domain weights by soft membership (operator 8).

A softmax classifier on hashed text, fitted on a labelled table, gives each document the posteriors p_d of
its domains.  Rates r_d ≥ 0 are fitted so that the expected domain shares of tokens, Σ r_d t_d p_d / T,
match the targets b: least squares, by projected gradient from r = 1.  The residual is measured in the
norm of M⁻¹, M = Σ t_d p_d p_dᵀ / T, and rates in the norm of their tokens, so step 1 is safe and
r_d ← max(0, r_d - p_d · M⁻¹ (a - b)).

A round is one aggregation over the narrow posterior table that sends K sums to the driver.  The rates
are never stored: a rate follows from its posteriors and the short list of the rounds' directions, so
each round (and the last) recomputes it where the row is read.  No shuffle, no state to lose.

Cases: null or empty text has no tokens and moves nothing; it gets a rate like any row.  A domain without
labelled rows is left out, and targets are made to sum to one over those that exist.  If nothing is
labelled or nothing has tokens, all rates are 1.  Repeated rows count one by one.  An input column with
the name of a computed one is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_text as H
from .common import stored

PER_DOMAIN = 1000
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
NEW = ["n_tokens", "domain", "posteriors", "rate", "copies"]


@dataclass
class Model:
    domains: list[str]
    weights: np.ndarray                                   # DIM × K
    bias: np.ndarray                                      # K
    steps: list[np.ndarray] = field(default_factory=list)  # the rounds' directions, K numbers each


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def softmax_loss(scores, extra, y, weight):
    p = softmax(scores + extra[None, :])
    rows = np.arange(len(y))
    value = float(-(np.log(np.maximum(p[rows, y], 1e-12)) * weight).sum())
    p[rows, y] -= 1
    p *= weight[:, None]
    return value, p, p.sum(axis=0)


def train(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], per_domain: int = PER_DOMAIN) -> Model | None:
    """Fit on ``labelled(doc_id, domain)``, at most ``per_domain`` rows of each domain that has a target."""
    names = sorted(targets)
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(names)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = stored(H.sampled(known, "domain", per_domain))
    domains = sorted(r.domain for r in sample.select("domain").distinct().collect())      # one row a domain
    if not domains:
        return None
    number = F.element_at(F.create_map(*[x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(k))]), F.col("domain"))
    rows = H.training_rows(docs, sample.withColumn("y", number), "y")
    w, bias = H.fit(rows, softmax_loss, len(domains), np.zeros(len(domains)), rounds=15)
    return Model(domains, w, bias)


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, posteriors) of every row; a token is a run of characters that are not white space."""
    def run(batches):
        for batch in batches:
            for a, p, words in _classified(batch.column(1), model):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(p)), pa.array(words, pa.int64()), _lists(p)],
                                                 names=["doc_id", "n_tokens", "posteriors"])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, posteriors array<double>")


def _classified(column: pa.Array, m: Model):
    for a, x, words in H.blocks(column):
        yield a, softmax(x @ m.weights + m.bias[None, :]), words


def _lists(p: np.ndarray) -> pa.Array:
    k = p.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.ravel()))


def replay(p: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rates after these rounds, and the rates one round before."""
    r = before = np.ones(len(p))
    for step in steps:
        before, r = r, np.maximum(0.0, r - p @ step)
    return r, before


def _round(table: DataFrame, steps: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Sums over all rows: t·r·p, t·p·pᵀ, t, and t times the squared last change of the rate."""
    def run(batches):
        total = np.zeros(k + k * k + 2)
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(0).to_numpy().astype(float)
            p = b.column(1).flatten().to_numpy().reshape(-1, k)
            r, before = replay(p, steps)
            total[:k] += (t * r) @ p
            total[k:-2] += ((p * t[:, None]).T @ p).ravel()
            total[-2] += t.sum()
            total[-1] += float(t @ (r - before) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])
    got = (table.select("n_tokens", "posteriors").mapInArrow(run, "i int, v double")
           .groupBy("i").agg(F.sum("v").alias("v")).collect())      # K·K + K + 2 rows
    s = np.zeros(k + k * k + 2)
    for r in got:
        s[r.i] = r.v
    return s[:k], s[k:-2].reshape(k, k), s[-2], s[-1]


def fit_rates(table: DataFrame, model: Model, targets: dict[str, float], tolerance: float = 1e-4, rounds: int = 500) -> Model:
    """``model`` with the directions that bring the shares to the targets; stops when the rates stand still."""
    k = len(model.domains)
    b = np.array([targets[d] for d in model.domains], float)
    b = b / b.sum()
    steps: list[np.ndarray] = []
    for _ in range(rounds):
        shares, m, total, change = _round(table, steps, k)
        if total <= 0 or (steps and change / total < tolerance ** 2):
            return Model(model.domains, model.weights, model.bias, steps)
        steps.append(np.linalg.pinv(m / total, rcond=1e-9) @ (shares / total - b))
    raise RuntimeError(f"the rates still change after {rounds} rounds")


def with_rates(docs: DataFrame, model: Model | None, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, domain, posteriors, rate and copies; no shuffle."""
    docs = docs.drop(*[c for c in NEW if c != "text"])
    names = docs.columns
    plain = [c for c in names if keep_text or c != "text"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in plain)
    if model is None:
        out = docs.withColumns({"n_tokens": F.lit(None).cast("long"), "domain": F.lit(None).cast("string"),
                                "posteriors": F.lit(None).cast("array<double>"), "rate": F.lit(1.0)})
    else:
        def run(batches):
            m = model                 # DIM × K numbers and the short list of directions
            for batch in batches:
                for a, p, words in _classified(batch.column(names.index("text")), m):
                    rate, _ = replay(p, m.steps)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(names.index(c)).slice(a, len(p)) for c in plain), pa.array(words, pa.int64()),
                         pa.array([m.domains[j] for j in p.argmax(axis=1)], pa.string()), _lists(p), pa.array(rate)],
                        names=plain + NEW[:4])
        out = docs.mapInArrow(run, fields + "n_tokens bigint, domain string, posteriors array<double>, rate double")
    return out.select(*plain, *NEW[:4], copies().alias("copies"))


def copies():
    """A whole number of copies whose expectation over documents is the rate, fixed by a hash of doc_id."""
    u = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(F.col("rate") + u).cast("long")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, keep_text: bool = True) -> DataFrame:
    """Train, fit and apply: ``docs`` with n_tokens, domain, posteriors, rate and copies."""
    targets = targets or TARGETS
    model = train(docs, labelled, targets)
    if model is not None:
        model = fit_rates(stored(posteriors(docs, model)), model, targets)
    return with_rates(docs, model, keep_text)
