"""Hashed text features and the distributed fit of linear models on them.

A text gives three groups of counts, each hashed into a fixed number of places: byte 3-grams of the
lower-cased text, 4-grams of byte classes (letter case, digit, white space, each sign), and whether a
word repeats the one before.  A group's counts become square roots of shares, so every text has the
same norm whatever its length.
"""

from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, slices, stored, to_bytes, word_hashes, word_starts

GROUP = 4096
DIM = 2 * GROUP + 2          # two hashed groups, and the words that repeat or don't repeat the last
LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
# 1 lower case, 2 upper case, 3 digit, 4 white space, 5 beyond ASCII; other signs are themselves
CLASS = np.array([1 if 0x61 <= c <= 0x7A else 2 if 0x41 <= c <= 0x5A else 3 if 0x30 <= c <= 0x39 else
                  4 if c == 0x20 or 0x09 <= c <= 0x0D else 5 if c >= 0x80 else c for c in range(256)], np.uint8)
IS_WORD = CLASS != 4
BLOCK_ROWS = 64              # texts whose dense counts are held at once


def counts(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The feature matrix of the texts (rows × DIM), and their numbers of words."""
    n = len(texts)
    out = np.zeros((n, DIM))
    lengths = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    offsets = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(n), lengths + 1)[:len(buf)]
    left = (offsets + lengths)[owner] - np.arange(len(buf))     # bytes up to the end of the text
    for g, (table, size) in enumerate(((LOWER, 3), (CLASS, 4))):
        b = table[buf].astype(np.uint32)
        m = len(buf) - size + 1
        if m > 0:
            key = np.zeros(m, np.uint64)
            for j in range(size):
                key = (key << np.uint64(8)) | b[j:j + m].astype(np.uint64)
            at = (mix(key) >> np.uint64(52)).astype(np.int64)    # GROUP = 2 ** 12 places
            ok = left[:m] >= size
            out[:, g * GROUP:(g + 1) * GROUP] = np.bincount(owner[:m][ok] * GROUP + at[ok], minlength=n * GROUP).reshape(n, GROUP)
    starts, ends = word_starts(buf, IS_WORD)
    first = np.searchsorted(starts, offsets)
    words = np.diff(np.append(first, len(starts)))
    if len(starts) > 1:
        h = word_hashes(buf, starts, ends)
        own = np.repeat(np.arange(n), words)
        pair = own[1:] == own[:-1]
        again = h[1:] == h[:-1]
        out[:, 2 * GROUP] = np.bincount(own[1:][pair & again], minlength=n)
        out[:, 2 * GROUP + 1] = np.bincount(own[1:][pair & ~again], minlength=n)
    for a, b in ((0, GROUP), (GROUP, 2 * GROUP), (2 * GROUP, DIM)):
        total = out[:, a:b].sum(axis=1, keepdims=True)
        out[:, a:b] = np.sqrt(out[:, a:b] / np.maximum(total, 1))
    return out, words


def blocks(column: pa.Array, rows: int = BLOCK_ROWS):
    """(first row, features, words) of a column of texts, block by block; a long text is a block of its own."""
    for a, b in slices(column):
        texts = to_bytes(column.slice(a, b - a))
        for k in range(0, len(texts), rows):
            x, words = counts(texts[k:k + rows])
            yield a + k, x, words


def sampled(labelled: DataFrame, label: str, per_label: int) -> DataFrame:
    """Up to ``per_label`` rows of each label, those with the least hashes of doc_id, with the weight that each stands for.

    A cut-off of the hashes, from the labels' counts, leaves about ``per_label`` rows a label before they are sorted (more by
    eight standard deviations, so that none of them is missed)."""
    total = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    share = (per_label + 8 * per_label ** 0.5 + 64) / F.col("_n")
    near = (labelled.join(F.broadcast(total), label)     # one row a label
            .where(F.xxhash64("doc_id") / 2.0 ** 64 + 0.5 < share))
    w = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    top = near.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_label).drop("_k")
    return top.withColumn("weight", F.col("_n") / F.least("_n", F.lit(per_label))).drop("_n")


def training_rows(docs: DataFrame, sample: DataFrame, label: str, parts: int = 8) -> DataFrame:
    """The sample's sparse features (y, weight, at, value), written once.  The sample's size is a parameter,
    so it is sent to the scan of the documents."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", F.col(label).cast("int").alias("y"), "weight")), "doc_id")

    def run(batches):
        for batch in batches:
            y, weight = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, x, _ in blocks(batch.column(2)):
                r, c = np.nonzero(x)
                ends = np.append(0, np.cumsum(np.bincount(r, minlength=len(x)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[a:a + len(x)]), pa.array(weight[a:a + len(x)]),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(c.astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(x[r, c].astype(np.float32)))],
                    names=["y", "weight", "at", "value"])
    out = rows.select("y", "weight", "text").mapInArrow(run, "y int, weight double, at array<int>, value array<float>")
    return stored(out.repartition(parts))


Loss = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]]


def fit(rows: DataFrame, loss: Loss, outputs: int, extra: np.ndarray, l2: float = 1e-4, rounds: int = 40,
        tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights DIM × outputs, extra parameters) by L-BFGS; every evaluation is one job over ``rows``, of which
    the driver gets one gradient a partition.

    ``loss(scores, extra, y, weight)`` gives the summed loss, its gradient by score and by extra parameter."""
    size = DIM * outputs

    def evaluate(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, ex = p[:size].reshape(DIM, outputs), p[size:]

        def run(batches):
            value, mass, grad = 0.0, 0.0, np.zeros(len(p))
            for b in batches:
                if not b.num_rows:
                    continue
                y, weight = b.column(0).to_numpy(), b.column(1).to_numpy()
                at, v = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(float)
                row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy())
                scores = np.stack([np.bincount(row, weights=v * w[at, k], minlength=b.num_rows) for k in range(outputs)], axis=1)
                part, by_score, by_extra = loss(scores, ex, y, weight)
                value += part
                mass += weight.sum()
                for k in range(outputs):
                    grad[k:size:outputs] += np.bincount(at, weights=v * by_score[row, k], minlength=DIM)
                grad[size:] += by_extra
            yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([mass]), pa.array([grad.tolist()])], names=["v", "m", "g"])
        got = rows.mapInArrow(run, "v double, m double, g array<double>").toArrow()
        mass = max(sum(got["m"].to_pylist()), 1e-12)
        grad = np.sum([np.array(g) for g in got["g"].to_pylist()], axis=0) / mass if got.num_rows else np.zeros(len(p))
        grad[:size] += l2 * p[:size]
        return sum(got["v"].to_pylist()) / mass + l2 / 2 * float(p[:size] @ p[:size]), grad

    p = lbfgs(evaluate, np.concatenate((np.zeros(size), extra)), rounds, tolerance)
    return p[:size].reshape(DIM, outputs), p[size:]


def lbfgs(f, p: np.ndarray, rounds: int, tolerance: float, memory: int = 8) -> np.ndarray:
    value, grad = f(p)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(grad).max() < tolerance:
            break
        q, used = grad.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            used.append(a)
            q -= a * y
        q *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1]) if steps else 1 / max(np.linalg.norm(grad), 1e-12)
        for (s, y), a in zip(steps, reversed(used)):
            q += s * (a - (y @ q) / (s @ y))
        length, slope = 1.0, -(grad @ q)
        while True:
            new = p - length * q
            new_value, new_grad = f(new)
            if new_value <= value + 1e-4 * length * slope or length < 1e-3:
                break
            length /= 4
        if new_value >= value:
            break
        s, y = new - p, new_grad - grad
        if s @ y > 1e-12:
            steps = (steps + [(s, y)])[-memory:]
        p, value, grad = new, new_value, new_grad
    return p


def held_out(doc_id: Column) -> Column:
    """Labels of these documents are not learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
