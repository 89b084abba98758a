"""Toxicity by compression distance (operator 2).

Two zstandard dictionaries are trained, one on windows of toxic text and one on windows of ordinary text.
A window is a word, repeated so that a frame is long enough to compress.  The toxic dictionary learns
the words that toxic documents have clearly more often than ordinary ones; a window whose length under it
falls short of its length under the ordinary dictionary tells of toxicity.  What a pair of lengths is
worth is not guessed but calibrated, on labelled documents that no dictionary has seen: the log-odds of
each (difference, length under the toxic dictionary, word length), and then a logistic curve over a
document's three highest log-odds, its share of high ones and its length.

The fit reads at most ``per_label`` labelled rows of each label (weighted by what they stand for) and
sends bounded lists of words and counts to the driver; scoring reads every whole text and does not shuffle.

Cases: null or empty text has no window and gets the score of a document without any sign.  Labels of
unknown documents and null labels are not used; of repeated labels the highest counts.  Without toxic or
without ordinary labelled rows every score is 0.  Repeated rows are scored one by one.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashed_text as H
from .common import stored, to_bytes

PER_LABEL = 6000
DICT_BYTES, LEVEL, REPEATS = 4096, 19, 3
MOST_WORDS = 20_000          # windows that a dictionary is trained on
SIGN_BYTES = 8192            # of the toxic words that its dictionary holds as a whole
LEAST_SHARE, LEAST_RATIO = 0.011, 10.0    # of the toxic documents (three at least) that have a sign, and times as often
THRESHOLD = 0.3
HIGH = 2.0                   # a log-odds that counts as high
CACHE = 400_000              # word values a task remembers; beyond, it starts anew
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


@dataclass
class Model:
    toxic: bytes                               # dictionaries
    ordinary: bytes
    odds: dict[tuple[int, int, int], float]    # log-odds by cell
    mean: np.ndarray
    scale: np.ndarray
    curve: np.ndarray                          # logistic weights, the last is the constant


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def trained(windows: list[tuple[bytes, int]], whole: int = 0) -> bytes:
    """A dictionary of windows that occur so many times; the first ones, up to ``whole`` bytes, are in it as a
    whole, the most frequent at the end, where a match is cheapest."""
    # training looks for the best piece of each stretch of the samples: mixed, all stretches are alike
    samples = [b" " + w + b" " for _, w in sorted((zlib.crc32(b"%d %s" % (k, w)), w) for w, n in windows for k in range(min(n, 200)))]
    try:
        out = zstandard.train_dictionary(DICT_BYTES, samples, k=32, d=6, level=LEVEL).as_bytes()
    except zstandard.ZstdError:      # too few windows to train on: they are the dictionary
        out = b"".join(samples)[-DICT_BYTES:].rjust(16, b" ")
    return out + b"".join(b" " + w + b" " for w, _ in reversed(windows))[-whole:] if whole else out


class Lengths:
    """The cell of a word: how its window compresses under either dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.compressors = []
        for raw in (toxic, ordinary):
            d = zstandard.ZstdCompressionDict(raw)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                                                               write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def cell(self, word: bytes) -> tuple[int, int, int]:
        window = (b" " + word + b" ") * REPEATS
        toxic, ordinary = (len(c(window)) for c in self.compressors)
        return max(-3, min(8, ordinary - toxic)), min(toxic, 26), min(len(word), 12)


class Scorer:
    def __init__(self, model: Model):
        self.lengths = Lengths(model.toxic, model.ordinary)
        self.odds = model.odds
        self.known: dict[bytes, float] = {}

    def features(self, text: bytes) -> list[float]:
        words = words_of(text)
        get = self.known.get
        values = list(map(get, words))
        if None in values:
            if len(self.known) > CACHE:
                self.known.clear()
            for k, v in enumerate(values):
                if v is None:
                    w = words[k]
                    v = get(w)
                    if v is None:
                        v = self.known[w] = self.odds.get(self.lengths.cell(w), 0.0)
                    values[k] = v
        top = heapq.nlargest(3, values) + [0.0] * 3
        high = sum(v > HIGH for v in values)
        return [top[0], top[1], top[2], float(np.log1p(len(values))), high / (1 + len(values)) ** 0.5]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a logistic curve by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """Fit on ``labels(doc_id, toxic)``: folds 0 and 1 train the dictionaries, 3 calibrates, 2 is held out."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~H.held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    sample = H.sampled(known, "toxic", per_label)
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")     # bounded by per_label
                  .select("toxic", "weight", (fold(F.col("doc_id")) == 3).alias("calibrate"), "text").repartition(8))

    def distinct_words(batches):
        for b in batches:
            words, toxic = [], []
            for y, text in zip(b.column(0).to_pylist(), to_bytes(b.column(1))):
                own = set(words_of(text))
                words += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(toxic, pa.int32())], names=["w", "y"])

    learn = rows.where("NOT calibrate")
    size = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}     # two rows
    if not size.get(0) or not size.get(1):
        return None
    counted = stored(learn.select("toxic", "text").mapInArrow(distinct_words, "w binary, y int").groupBy("w")
                     .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("o")))
    ratio = (F.col("t") / size[1]) / ((F.col("o") + 0.5) / size[0])

    def most(df: DataFrame, by: str) -> list[tuple[bytes, int]]:
        return [(bytes(r.w), r[by]) for r in df.orderBy(F.desc(by), "w").limit(MOST_WORDS).collect()]
    signs = most(counted.where((F.col("t") >= max(3, round(LEAST_SHARE * size[1]))) & (ratio > LEAST_RATIO)), "t")
    plain = most(counted.where("o > 0"), "o")
    if not signs or not plain:
        return None
    toxic, ordinary = trained(signs, SIGN_BYTES), trained(plain)

    def cells(batches):
        lengths = Lengths(toxic, ordinary)
        for b in batches:
            out = []
            for y, text in zip(b.column(0).to_pylist(), to_bytes(b.column(1))):
                out += [(y, *c) for c in {lengths.cell(w) for w in set(words_of(text))}]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], names=["y", "d", "t", "n"])

    check = rows.where("calibrate")
    total = {r.toxic: r.n for r in check.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return None
    table = (check.select("toxic", "text").mapInArrow(cells, "y int, d int, t int, n int").groupBy("d", "t", "n")
             .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("ordinary")).collect())     # at most 12 · 27 · 13 rows
    odds = {(r.d, r.t, r.n): float(np.log((r.toxic + 0.5) / (total[1] + 1)) - np.log((r.ordinary + 0.5) / (total[0] + 1))) for r in table}
    model = Model(toxic, ordinary, odds, np.zeros(5), np.ones(5), np.zeros(6))

    def features(batches):
        scorer = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([scorer.features(t) for t in to_bytes(b.column(2))], pa.list_(pa.float64()))],
                                             names=["y", "weight", "x"])
    seen = check.select("toxic", "weight", "text").mapInArrow(features, "y int, weight double, x array<double>").collect()   # at most 2 · per_label rows
    y, weight = np.array([r.y for r in seen]), np.array([r.weight for r in seen])
    model.mean, model.scale, model.curve = logistic(np.array([r.x for r in seen]), y, weight / weight.mean())
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    base = docs.select("doc_id", F.coalesce(H.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    if model is None:
        out = base.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        def run(batches):
            m = model                 # two dictionaries and one table of cells
            scorer = Scorer(m)
            for b in batches:
                x = np.array([scorer.features(t) for t in to_bytes(b.column(2))]).reshape(-1, 5)
                z = np.c_[(x - m.mean) / m.scale, np.ones(len(x))] @ m.curve
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                                                 names=["doc_id", "held_out", "score"])
        out = base.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
