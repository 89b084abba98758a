"""Best-fit packing of tokenised documents into sequences of a fixed length (operator 11).

1. *Pieces.*  Every document is encoded once; one longer than ``limit`` tokens is cut into pieces of ``limit``,
   of which the first may be shorter.  A piece row has its length, its checksum, and its number among the
   pieces of that length that its task wrote.
2. *Plan.*  The histogram of lengths (``limit`` rows at most, whatever the corpus) goes to the driver.
   Patterns of one, two and three lengths that fill a sequence as well as lengths in stock can are enumerated; non-negative
   least squares fits how often each is used to the histogram; the counts are rounded down to what
   the stock allows, twice over; what is left is packed by best fit, longest first, also into gaps of the patterns.
   If plain best fit of everything needs fewer sequences, that is the plan.
3. *Places.*  The plan is a table of intervals: the pieces of length l with numbers a to b lie at one offset of consecutive
   sequences.  A piece's number is its number in its task plus the pieces of that length of earlier
   tasks.  So no piece meets another one: only counts are shuffled and narrow rows joined to them.

The plan's size is bounded by the number of patterns, a function of ``limit`` alone, so it is broadcast.

Cases: null text is empty; an empty document is the one id ``end``.  Rows are packed one by one, so
repeated rows and null ids are kept.  No rows: no pieces.  Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, read_definition
from .common import repeat_ranges, slices, stored, to_bytes

LIMIT, END = 1024, 2
ROUNDS, STEPS = 3, 400          # fits, and gradient steps of each
Group = tuple[tuple[int, ...], int]       # lengths of a sequence, how many such sequences


def pieces(docs: DataFrame, limit: int = LIMIT, end: int = END, definition: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): the pieces of each document of ``docs(doc_id, text)``."""
    shipped = docs.sparkSession.sparkContext.broadcast(definition or read_definition())
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        from pyspark import TaskContext
        bpe, part, seen = ByteBpe(shipped.value), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                sizes, sums = [], []
                for text in to_bytes(batch.column(1).slice(a, b - a)):
                    raw = np.append(bpe.ids(text.decode("utf-8", "replace")), np.uint32(end)).astype("<u4").tobytes()
                    sizes.append(len(raw) // 4)
                    cuts = [0, *range(4 * ((len(raw) // 4 - 1) % limit + 1), len(raw) + 1, 4 * limit)]
                    sums += [zlib.crc32(raw[x:y]) for x, y in zip(cuts, cuts[1:])]
                total = np.array(sizes, np.int64)
                many = -(-total // limit)
                own = np.repeat(np.arange(b - a), many)
                nth = repeat_ranges(np.zeros(b - a, np.int64), many)
                first = (total - 1) % limit + 1
                length = np.where(nth == 0, first[own], limit)
                start = np.where(nth == 0, 0, first[own] + (nth - 1) * limit)
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(own), np.int64)
                stock = np.bincount(length, minlength=limit + 1)
                rank[order] = repeat_ranges(seen[stock > 0], stock[stock > 0])
                seen += stock
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(own)), pa.array(nth, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(sums, pa.int64()), pa.array(np.full(len(own), part), pa.int32()), pa.array(rank, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
    return base.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint")


def patterns(stock: np.ndarray, limit: int) -> np.ndarray:
    """Rows (a, b, c), a ≤ b ≤ c, 0 for none: for each a, and each a and b, the longest last length in stock that fits."""
    have = np.flatnonzero(stock[1:limit + 1]) + 1
    if not len(have):
        return np.zeros((0, 3), np.int64)
    longest = np.zeros(limit + 1, np.int64)      # the longest length in stock up to each
    longest[have] = have
    longest = np.maximum.accumulate(longest)
    c = longest[limit - have[have < limit]]
    a = have[have < limit]
    two = np.stack([np.zeros_like(a), a, c], axis=1)[c >= a]
    rows = [np.array([[0, 0, have[-1]]]), two]
    for a in have[have <= limit // 3]:
        b = have[(have >= a) & (have <= (limit - a) // 2)]
        c = longest[limit - a - b]
        ok = c >= b
        rows.append(np.stack([np.full(int(ok.sum()), a), b[ok], c[ok]], axis=1))
    return np.concatenate(rows)


def nnls(rows: np.ndarray, stock: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Counts x ≥ 0 of the patterns that bring the lengths they use nearest to ``stock``, in the least squares sense
    (accelerated projected gradient)."""
    def use(x):
        out = np.zeros(len(stock))
        for k in range(3):
            out += np.bincount(rows[:, k], weights=x, minlength=len(stock))
        out[0] = 0
        return out

    def back(r):
        r = r.copy()
        r[0] = 0
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    v = np.ones(len(rows))
    for _ in range(20):                  # the largest curvature, by the power method
        w = back(use(v))
        v = w / max(np.linalg.norm(w), 1e-12)
    step = 1 / max(1.05 * np.linalg.norm(back(use(v))), 1e-12)
    x = y = np.zeros(len(rows))
    t, target = 1.0, stock.astype(float)
    for _ in range(steps):
        new = np.maximum(y - step * back(use(y) - target), 0)
        if (y - new) @ (new - x) > 0:    # the momentum points uphill: start it anew
            t = 1.0
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def best_fit(stock: np.ndarray, limit: int, opened: list[Group]) -> list[Group]:
    """``opened`` and further sequences with all of ``stock`` put in, longest first, each piece where it leaves the
    least room.  Sequences with equal lengths are handled together, so the work doesn't grow with the corpus."""
    room: dict[int, dict[tuple[int, ...], int]] = {}

    def put(lengths, n):
        if n:
            kinds = room.setdefault(limit - sum(lengths), {})
            kinds[lengths] = kinds.get(lengths, 0) + n

    for lengths, n in opened:
        put(lengths, n)
    for length in range(limit, 0, -1):
        left = int(stock[length])
        while left:
            fit = min((r for r in room if r >= length and room[r]), default=None)
            if fit is None:
                per = limit // length
                put((length,) * per, left // per)
                put((length,) * (left % per), int(left % per > 0))
                break
            lengths, n = room[fit].popitem()
            per = fit // length if n * (fit // length) <= left else 1
            used = min(n, left // per)
            put(lengths + (length,) * per, used)
            if n > used:
                room[fit][lengths] = room[fit].get(lengths, 0) + n - used
            left -= used * per
    return [(lengths, n) for kinds in room.values() for lengths, n in kinds.items() if n]


def plan(stock: np.ndarray, limit: int = LIMIT, rounds: int = ROUNDS) -> list[Group]:
    """Sequences that hold ``stock[l]`` pieces of each length l (1 to ``limit``)."""
    stock = np.asarray(stock, np.int64)
    left, groups = stock.copy(), []
    for _ in range(rounds):
        rows = patterns(left, limit)
        rows = rows[rows.sum(axis=1) >= limit - limit // 64]      # the others are best fit's work
        if not len(rows):
            break
        x = np.floor(nnls(rows, left) + 1e-6).astype(np.int64)
        took = 0
        for k in np.argsort(-x, kind="stable"):
            if x[k] <= 0:
                break
            lengths = tuple(int(v) for v in rows[k] if v)
            n = min([int(x[k]), *(int(left[v]) // lengths.count(v) for v in lengths)])
            if n:
                groups.append((lengths, n))
                for v in lengths:
                    left[v] -= n
                took += n
        if not took:
            break
    fitted = best_fit(left, limit, groups)
    plain = best_fit(stock, limit, [])
    return min(fitted, plain, key=lambda g: sum(n for _, n in g))


def intervals(groups: list[Group]) -> np.ndarray:
    """Rows (length, first number, offset, sequence of the first) of the plan, sorted: from that number on, the pieces of that
    length lie at that offset of consecutive sequences, up to the next row's."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in sorted(groups, key=lambda g: g[0]):
        at = 0
        for length in lengths:
            first = used.get(length, 0)
            rows.append((length, first, at, sequence))
            used[length] = first + n
            at += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, limit: int = LIMIT, end: int = END, definition: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece."""
    cut = stored(pieces(docs, limit, end, definition))
    stock = np.zeros(limit + 1, np.int64)
    for r in cut.groupBy("length").count().collect():      # ``limit`` rows at most
        stock[r["length"]] = r["count"]
    table = intervals(plan(stock, limit))
    shipped = docs.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
               .select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = cut.join(earlier, ["part", "length"]).select(*names, (F.col("nth") + F.col("_before")).alias("number"))

    def run(batches):
        t = shipped.value
        key = (t[:, 0] << 48) + t[:, 1]
        for b in batches:
            length, number = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(key, (length << 48) + number, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(t[at, 3] + number - t[at, 1], pa.int64()),
                                              pa.array(t[at, 2], pa.int64())], names=[*names, "sequence_id", "offset"])
    kinds = dict(numbered.dtypes)
    return numbered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")
