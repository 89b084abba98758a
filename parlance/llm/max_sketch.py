"""Ranked lexical search with hashed max-sketches (operator 12).

Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  The impact of a term in a document is
``(10^9 · tf) div (1000 · tf + 8 · m)``, m = 25 + (75 · n · N) div L; a query term of weight w = ⌊1000 · ln((2N + 2) / (2df + 1))⌋
adds w times its impact to the score.

1. One pass counts N, L and the df of the query terms: sums that the tasks make first.
2. A second pass folds the impacts of *all* terms of a document into a sketch of ``width`` coordinates: each term is hashed to one, which
   keeps the largest impact.  So the sketch at a query term's coordinate is never below the term's impact, and
   the weighted sum over a query's coordinates, looked up for all documents of a slice at once, is an upper bound of the score.
3. Documents are rescored exactly in descending order of the bound until it falls below the k-th best score that the task has found so
   far; a bound that equals it is still rescored, so ties are settled by doc_id.  The tasks' best are merged in two steps.

The queries are read in blocks of at most ``max_terms`` terms, so what is broadcast is bounded whatever the number of
queries; each further block is two more passes.  Query words are found by 64-bit hashes and then compared byte by byte.

Cases: null text has no terms and never scores.  Every query row is ranked, repeated ones repeatedly; one without terms has no
result.  Repeated documents are ranked one by one; a null doc_id comes after the others of its score.  No documents: no rows.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, repeat_ranges, slices, to_bytes, word_hashes, word_starts

TOP, WIDTH, MAX_TERMS = 10, 4096, 200_000
CHUNK = 32                   # documents rescored at once
IS_TERM = np.array([0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
NO_ID = np.iinfo(np.int64).max


def terms_of(text: bytes) -> list[bytes]:
    buf = np.frombuffer(text.translate(LOWER), np.uint8)
    raw = buf.tobytes()
    return [raw[a:b] for a, b in zip(*word_starts(buf, IS_TERM))]


class Vocabulary:
    """The distinct terms of a block of queries, found in a slice of texts by hash and then by their bytes."""

    def __init__(self, words: list[bytes]):
        buf = np.frombuffer(b" ".join(words), np.uint8)
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        h = word_hashes(buf, starts, starts + lengths)
        self.order = np.argsort(h, kind="stable")
        self.hashes, self.buf, self.starts, self.lengths = h[self.order], buf, starts, lengths

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word among those given, number of the term) of every occurrence of a term."""
        if not len(self.hashes) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        term = self.order[at[hit]]
        same = (ends - starts)[hit] == self.lengths[term]
        hit, term = hit[same], term[same]
        if not len(hit):
            return hit, term
        n = self.lengths[term]
        equal = buf[repeat_ranges(starts[hit], n)] == self.buf[repeat_ranges(self.starts[term], n)]
        same = np.add.reduceat(equal, np.cumsum(n) - n) == n
        return hit[same], term[same]


class Slice:
    """The terms of some texts: hashes, owners, numbers of terms, and the occurrences of the vocabulary's."""

    def __init__(self, texts: list[bytes], vocabulary: Vocabulary):
        self.docs = len(texts)
        buf = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
        starts, ends = word_starts(buf, IS_TERM)
        lengths = np.array([len(t) for t in texts], np.int64)
        first = np.searchsorted(starts, np.cumsum(lengths + 1) - lengths - 1)
        self.n = np.diff(np.append(first, len(starts)))
        self.owner = np.repeat(np.arange(self.docs), self.n)
        self.h = word_hashes(buf, starts, ends)
        word, term = vocabulary.find(buf, starts, ends, self.h)
        #: document · terms + term of every pair that occurs, and how often
        self.pairs, self.tf = np.unique(self.owner[word] * max(len(vocabulary.hashes), 1) + term, return_counts=True)

    def folded(self, m: np.ndarray, width: int) -> np.ndarray:
        """The sketches, width × documents."""
        order = np.lexsort((self.h, self.owner))
        h, own = self.h[order], self.owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        out = np.zeros((width, self.docs), np.int64)
        np.maximum.at(out, (coordinates(h[at], width), own[at]), impacts(tf, m[own[at]]))
        return out


def coordinates(h: np.ndarray, width: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Best:
    """The k best documents of one query so far: higher scores first, then lower ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores, scores)), np.concatenate((self.ids, ids))
        order = np.lexsort((ids, -scores))[:self.k]
        order = order[scores[order] > 0]
        self.scores, self.ids = scores[order], ids[order]


def rank_slice(part: Slice, ids: np.ndarray, m: np.ndarray, sketch: np.ndarray, queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
               terms: int, best: list[Best], chunk: int = CHUNK) -> int:
    """Brings ``best`` up to date with the documents of a slice; queries are (terms, their weights, their
    coordinates).  Returns how many documents were rescored."""
    rescored = 0
    exact = impacts(part.tf, m[part.pairs // terms])
    for (term, w, at), top in zip(queries, best):
        bound = w @ sketch[at]
        able = np.flatnonzero(bound >= top.least())
        able = able[np.argsort(-bound[able], kind="stable")]
        while len(able) and bound[able[0]] >= top.least():
            some, able = able[:chunk], able[chunk:]
            key = some[:, None] * terms + term[None, :]
            pos = np.minimum(np.searchsorted(part.pairs, key), max(len(part.pairs) - 1, 0))
            scores = (np.where(part.pairs[pos] == key, exact[pos], 0) @ w) if len(part.pairs) else np.zeros(len(some), np.int64)
            top.add(scores, ids[some])
            rescored += len(some)
    return rescored


def query_blocks(items: DataFrame, max_terms: int) -> Iterator[list[tuple[object, Counter]]]:
    """The queries that have a term, in blocks of at most ``max_terms`` distinct terms, one query at least."""
    block, size = [], 0
    for r in items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).toLocalIterator():
        terms = Counter(terms_of(r.t.encode()))
        if block and size + len(terms) > max_terms:
            yield block
            block, size = [], 0
        if terms:
            block.append((r.item_id, terms))
            size += len(terms)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = TOP, width: int = WIDTH, max_terms: int = MAX_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``docs(doc_id, text)`` for each row of ``items(item_id, text)``."""
    kind = dict(items.dtypes)["item_id"]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    out = None
    for block in query_blocks(items, max_terms):
        found = _search_block(base, block, k, width, kind)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def _search_block(base: DataFrame, block: list[tuple[object, Counter]], k: int, width: int, kind: str) -> DataFrame:
    spark = base.sparkSession
    words = sorted({w for _, terms in block for w in terms})
    number = {w: i for i, w in enumerate(words)}
    shipped = spark.sparkContext.broadcast(words)
    terms = len(words)

    def count(batches):
        vocabulary, df, n, total = Vocabulary(shipped.value), np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            for a, b in slices(batch.column(0)):
                part = Slice(to_bytes(batch.column(0).slice(a, b - a)), vocabulary)
                df += np.bincount(part.pairs % terms, minlength=terms)
                n += int((part.n > 0).sum())
                total += int(part.n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, total]))], names=["term", "n"])
    counted = base.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    sums = {r.term: r.n for r in counted.collect()}       # a row a query term at most
    n_docs, total = sums.get(-1, 0), sums.get(-2, 0)
    weights = np.array([weight(n_docs, sums.get(t, 0)) for t in range(terms)], np.int64)
    queries = []
    for _, q in block:
        own = np.array([number[w] for w in q], np.int64)
        queries.append((own, weights[own] * np.array(list(q.values()), np.int64)))
    sent = spark.sparkContext.broadcast(queries)

    def rank(batches):
        from pyspark import TaskContext
        vocabulary, best = Vocabulary(shipped.value), [Best(k) for _ in sent.value]
        place = np.empty(terms, np.int64)
        place[vocabulary.order] = coordinates(vocabulary.hashes, width)
        looked_up = [(t, w, place[t]) for t, w in sent.value]
        for batch in batches:
            doc_ids = batch.column(0).fill_null(NO_ID).to_numpy()
            for a, b in slices(batch.column(1)):
                part = Slice(to_bytes(batch.column(1).slice(a, b - a)), vocabulary)
                m = 25 + (75 * part.n * n_docs) // max(total, 1)
                rank_slice(part, doc_ids[a:b], m, part.folded(m, width), looked_up, terms, best)
        own = np.repeat(np.arange(len(best)), [len(x.ids) for x in best])
        ids = np.concatenate([x.ids for x in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(ids, mask=ids == NO_ID), pa.array(np.concatenate([x.scores for x in best])),
             pa.array(np.full(len(own), TaskContext.get().partitionId() % 64))], names=["query", "doc_id", "score", "salt"])
    found = base.mapInArrow(rank, "query bigint, doc_id bigint, score bigint, salt bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["query", "salt"], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query bigint, item_id {kind}")
    return found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")     # names: the block's queries


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""WITH d AS (SELECT doc_id, len(w) AS n, w FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, nn),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l)))) AS BIGINT) AS score
  FROM q JOIN f USING (t) JOIN p USING (t), c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""
