"""Repeated passages removed word by word, by super-k-mer partitioning (operator 4).

A window is 20 consecutive words of one document.  Its minimiser is the smallest hash among its
6-word runs; consecutive windows that share a minimiser form one super-k-mer, which is named by it.

0. Of documents with the same words only the first goes on; the others repeat it from end to end.
1. Every document is cut into super-k-mers (narrow rows: minimiser, place, number of windows).  Equal
   windows have equal minimisers, so only super-k-mers whose minimiser occurs twice can hold a
   repeated window; the others go no further.
2. Those travel as one packed string each to the bucket of their minimiser, sorted there by minimiser,
   string and place.  A string equal to the one before repeats all its windows and is not held.  The
   windows of the different strings are sorted by hash and place, equal neighbours are compared byte
   by byte, and all but the first of each are repeats.
3. A minimiser with more than ``bucket_bytes`` of different strings is not held either: its windows are
   dealt out one by one, each by its own text.
4. The repeated word ranges go back to their documents, where the words left are joined.

Cases: null text has no words.  Null ``doc_id`` counts as the largest id.  Repeated rows are one document
(they do not repeat each other); rows with one id and different texts are ordered by a hash of the text.
Documents of fewer than 20 words keep all words.  Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, repeat_ranges, slices, stored, to_bytes, word_hashes, word_starts

WINDOW, MINI = 20, 6
BUCKET_BYTES = 32 << 20
IS_WORD = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])
NULL_ID = (1 << 63) - 1


def sequence_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15 | 1) + words[j:j + len(out)]
    return mix(out)


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[:len(x) - (n - width)], x[n - width:]) if width < n else x


def super_kmers(texts: list[bytes], window: int = WINDOW, mini: int = MINI):
    """For all texts at once: (text number, first window, number of windows, minimiser, times that the
    minimiser occurs in it) of each super-k-mer."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    starts, ends = word_starts(buf, IS_WORD)
    if len(starts) < window:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    first_word = np.searchsorted(starts, offsets)
    counts = np.diff(np.append(first_word, len(starts)))
    owner = np.repeat(np.arange(len(texts)), counts)
    grams = sequence_hash(word_hashes(buf, starts, ends), mini)
    least = sliding_min(grams, window - mini + 1)
    at = np.flatnonzero(owner[:len(least)] == owner[window - 1:])
    if not len(at):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    value = least[at]
    new = np.concatenate(([True], (np.diff(at) != 1) | (value[1:] != value[:-1])))
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(at)))
    doc = owner[at[head]]
    span = n + window - mini
    times = np.add.reduceat((grams[repeat_ranges(at[head], span)] == np.repeat(value[head], span)).astype(np.int64),
                            np.cumsum(span) - span)
    return [doc, at[head] - first_word[doc], n, value[head], times]


def _cut(batch: pa.RecordBatch):
    """(doc_id, at, text) → (mini, doc_id, at, n, times); ``at`` has the text's hash above bit 32 and the word number below."""
    column, ids, hashes = batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for a, b in slices(column):
        doc, first, n, value, times = super_kmers(to_bytes(column.slice(a, b - a)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(value.view(np.int64)), pa.array(ids[a:b][doc]), pa.array((hashes[a:b][doc] << 32) | first),
             pa.array(n.astype(np.int32)), pa.array(times)], names=["mini", "doc_id", "at", "n", "times"])


def _pack(batch: pa.RecordBatch):
    """(doc_id, th, text, refs) → one packed string for each referenced super-k-mer."""
    rows = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
    ids, hashes = rows["doc_id"].to_numpy(), rows["th"].to_numpy()
    for a, b in slices(rows["text"], 1 << 20):
        mini, doc, at, n, packed = [], [], [], [], []
        for k, text in zip(range(a, b), to_bytes(rows["text"].slice(a, b - a))):
            words = text.split()
            flat = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            for ref in rows["refs"][k].as_py():
                i, m = ref["first"], ref["n"]
                mini.append(ref["mini"])
                doc.append(int(ids[k]))
                at.append(int(hashes[k]) << 32 | i)
                n.append(m)
                packed.append(flat[ends[i - 1] if i else 0:ends[i + m + WINDOW - 2] - 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(mini, pa.int64()), pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32()),
             pa.array(packed, pa.binary())], names=["mini", "doc_id", "at", "n", "packed"])


def repeated_windows(strings: list[bytes], doc: np.ndarray, at: np.ndarray, window: int = WINDOW):
    """(string number, first window, number of windows) of the runs of windows that occur before, by (doc, at)."""
    buf = np.frombuffer(b" ".join(strings), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in strings[:-1]])
    starts, ends = word_starts(buf, IS_WORD)
    first_word = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(len(strings)), np.diff(np.append(first_word, len(starts))))
    h = sequence_hash(word_hashes(buf, starts, ends, seed=7), window)
    win = np.flatnonzero(owner[:len(h)] == owner[window - 1:])
    h, own = h[win], owner[win]
    inside = win - first_word[own]
    order = np.lexsort((at[own] + inside, doc[own], h))
    hs = h[order]
    head = np.concatenate(([True], hs[1:] != hs[:-1]))
    leader = order[np.maximum.accumulate(np.where(head, np.arange(len(hs)), 0))]   # the first of each group
    # an equal place (a repeated row) is no earlier occurrence
    later = ~head & ~((doc[own][order] == doc[own][leader]) & (at[own][order] + inside[order] == at[own][leader] + inside[leader]))
    x, y = order[later], leader[later]
    a, b = starts[win[x]], starts[win[y]]
    la, lb = ends[win[x] + window - 1] - a, ends[win[y] + window - 1] - b
    same = la == lb
    for i in range(0, len(x), 50_000):     # byte by byte, so that a repeat is never only a matter of hashes
        part = slice(i, i + 50_000)
        ok = np.flatnonzero(same[part]) + i
        if len(ok):
            unequal = buf[repeat_ranges(a[ok], la[ok])] != buf[repeat_ranges(b[ok], la[ok])]
            same[ok] = ~np.logical_or.reduceat(unequal, np.cumsum(la[ok]) - la[ok])
    repeat = np.zeros(len(win), bool)
    repeat[x[same]] = True
    if not same.all():                     # one hash for different windows: those groups by their text
        for value in np.unique(h[x[~same]]):
            seen: set[bytes] = set()
            for k in order[np.searchsorted(hs, value):np.searchsorted(hs, value, side="right")]:
                text = buf[starts[win[k]]:ends[win[k] + window - 1]].tobytes()
                repeat[k] = text in seen
                seen.add(text)
    k = np.flatnonzero(repeat)
    if not len(k):
        return [np.zeros(0, np.int64)] * 3
    new = np.concatenate(([True], (np.diff(k) != 1) | (own[k][1:] != own[k][:-1])))
    first = np.flatnonzero(new)
    return [own[k[first]], inside[k[first]], np.diff(np.append(first, len(k)))]


def _count(bucket_bytes: int):
    """Over rows sorted by (mini, packed, doc_id, at): the repeated runs (packed null), and the strings of a
    minimiser that has too many of them (packed set)."""
    def batch_of(doc, at, n, packed=None):
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int32()),
             pa.array(packed if packed is not None else [None] * len(doc), pa.string())], names=["doc_id", "at", "n", "packed"])

    def flush(doc, at, strings):
        if not strings:
            return []
        d, p = np.array(doc, np.int64), np.array(at, np.int64)
        own, inside, n = repeated_windows(strings, d, p)
        return [batch_of(d[own], p[own] + inside, n)] if len(own) else []

    def run(batches):
        doc, at, strings, counts = [], [], [], []   # whole minimisers, then the current one from ``begun`` on
        begun, held, own_held = 0, 0, 0
        mini = last = None
        wide = False
        for batch in batches:
            out = [[], [], []]
            dealt = [[], [], [], []]
            m_, d_, a_, n_ = (batch.column(k).to_pylist() for k in range(4))
            for m, d, a, n, s in zip(m_, d_, a_, n_, to_bytes(batch.column(4))):
                if m != mini:
                    if held >= 1 << 20:
                        yield from flush(doc, at, strings)
                        doc, at, strings, counts, held = [], [], [], [], 0
                    mini, last, wide, begun, own_held = m, None, False, len(strings), 0
                if s == last:
                    if (d, a) != place:
                        out[0].append(d), out[1].append(a), out[2].append(n)
                    continue
                last, place = s, (d, a)
                if not wide and own_held + len(s) > bucket_bytes:
                    wide = True
                    for k, x in enumerate((doc, at, counts)):
                        dealt[k] += x[begun:]
                    dealt[3] += [x.decode() for x in strings[begun:]]
                    del doc[begun:], at[begun:], strings[begun:], counts[begun:]
                    held -= own_held
                if wide:
                    for x, v in zip(dealt, (d, a, n, s.decode())):
                        x.append(v)
                else:
                    doc.append(d), at.append(a), strings.append(s), counts.append(n)
                    held += len(s)
                    own_held += len(s)
            if out[0]:
                yield batch_of(*out)
            if dealt[0]:
                yield batch_of(*dealt)
        yield from flush(doc, at, strings)
    return run


def _one_by_one(wide: DataFrame) -> DataFrame:
    """Repeated windows among packed strings, each window dealt by its own text."""
    words = F.split("packed", " ")
    win = (wide.withColumn("w", words).select("doc_id", "at", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
           .select("doc_id", (F.col("at") + F.col("i")).alias("at"),
                   F.array_join(F.slice("w", F.col("i") + 1, F.lit(WINDOW)), " ").alias("t")))
    first = win.groupBy("t").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    return (win.join(first, "t").where(F.struct("doc_id", "at") > F.col("first"))
            .select("doc_id", "at", F.lit(1).alias("n"), F.lit(None).cast("string").alias("packed")))


def _whole(batch: pa.RecordBatch):
    """(doc_id, th, text) → words and hash of the whole text."""
    counts, shas = [], []
    for text in to_bytes(batch.column(2)):
        words = text.split()
        counts.append(len(words))
        shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string())],
                                     names=["doc_id", "th", "n_words", "whole_sha256"])


def _keep(with_text: bool):
    """(doc_id, th, text, first[], n[]) → what is left of the text."""
    def run(batch: pa.RecordBatch):
        removed, shas, kept_texts = [], [], []
        texts = to_bytes(batch.column(2))
        for text, first, n in zip(texts, batch.column(3), batch.column(4)):
            words = text.split()
            step = np.zeros(len(words) + 1, np.int64)
            f = first.values.to_numpy()
            np.add.at(step, f, 1)
            np.add.at(step, f + n.values.to_numpy() + WINDOW - 1, -1)
            keep = np.cumsum(step[:-1]) == 0
            left = b" ".join([words[i] for i in np.flatnonzero(keep)])
            removed.append(len(words) - int(keep.sum()))
            shas.append(hashlib.sha256(left).hexdigest())
            kept_texts.append(left.decode() if with_text else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
             pa.array(kept_texts, pa.string())], names=["doc_id", "th", "n_removed", "kept_sha256", "kept_text"])
    return run


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield from fn(b)
    return df.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row; ``with_text`` adds kept_text where words were removed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"),
                       F.crc32(text.cast("binary")).bitwiseAND(0x7FFFFFFF).alias("th"), text.alias("text"))
    runs = mapped(base, _cut, "mini bigint, doc_id bigint, at bigint, n int, times bigint")
    twice = runs.groupBy("mini").agg(F.sum("times").alias("times")).where("times > 1").select("mini")
    refs = (runs.join(twice, "mini", "left_semi")
            .select("doc_id", F.shiftright("at", 32).alias("th"),
                    F.struct("mini", F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("first"), "n").alias("ref"))
            .groupBy("doc_id", "th").agg(F.collect_set("ref").alias("refs")))
    whole = stored(mapped(base, _whole, "doc_id bigint, th bigint, n_words bigint, whole_sha256 string"))
    first = whole.groupBy("whole_sha256", "n_words").agg(F.min("doc_id").alias("first"))
    whole = (whole.join(first, ["whole_sha256", "n_words"])
             .withColumn("copy", (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)))
    suspects = stored(base.join(refs.join(whole.where("copy"), ["doc_id", "th"], "left_anti"), ["doc_id", "th"]))
    packed = mapped(suspects, _pack, "mini bigint, doc_id bigint, at bigint, n int, packed binary")
    found = stored(packed.repartition("mini").sortWithinPartitions("mini", "packed", "doc_id", "at")
                   .mapInArrow(_count(bucket_bytes), "doc_id bigint, at bigint, n int, packed string"))
    wide = found.where("packed IS NOT NULL")
    ranges = found.where("packed IS NULL")
    if not wide.isEmpty():
        ranges = ranges.unionByName(_one_by_one(wide))
    ranges = (ranges.groupBy("doc_id", F.shiftright("at", 32).alias("th"))
              .agg(F.collect_list(F.struct(F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("first"), "n")).alias("r"))
              .select("doc_id", "th", F.col("r.first").alias("first"), F.col("r.n").alias("n")))
    cut = mapped(suspects.select("doc_id", "th", "text").join(ranges, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"]),
                 _keep(with_text), "doc_id bigint, th bigint, n_removed bigint, kept_sha256 string, kept_text string")
    out = whole.join(cut, ["doc_id", "th"], "left").select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out if with_text else out.drop("kept_text")


ORACLE = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM rep),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""
