"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 10).

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z.  The patterns are
the windows of 13 consecutive item words; an item of fewer words is one pattern.  Patterns of one
length are searched together: a block is three words (fewer for shorter patterns), the shift table
tells for each block that occurs in a pattern how far its end can at least be from the pattern's end,
and any other block lets the search skip nearly a whole pattern.  At shift 0 the block picks a bucket
of patterns, told apart by their first word, and the words are compared one by one.

The items are read in blocks of at most ``max_words`` words, so what is broadcast is bounded whatever
the benchmark's size; each further block is one more pass over the documents.  There is no shuffle.

Cases: null text has no words; a document or an item without words has no hit.  Null ``item_id``
counts as the item id ''.  Repeated rows are judged one by one.  An input column with the name of a
computed one is replaced.
"""

from __future__ import annotations

import hashlib
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, to_bytes

WINDOW = 13
MAX_WORDS = 200_000      # item words held in a task at once
WORD_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20
                   for c in range(256))
STATE = "_words bigint, _starts array<int>, _ends array<int>, _items array<string>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_TABLE).split()


class Matcher:
    """Shift tables and buckets of one block of items."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int = WINDOW):
        owners: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            w = words_of(text)
            m = min(window, len(w))
            for i in range(len(w) - m + 1 if w else 0):
                owners.setdefault(m, {}).setdefault(tuple(w[i:i + m]), set()).add(item)
        self.tables = []
        for m, patterns in sorted(owners.items()):
            b = min(3, m)
            shift: dict[tuple, int] = {}
            bucket: dict[tuple, dict[bytes, list]] = {}
            for p, own in patterns.items():
                for q in range(b, m + 1):
                    block = p[q - b:q]
                    if m - q < shift.get(block, m):
                        shift[block] = m - q
                bucket.setdefault(p[m - b:], {}).setdefault(p[0], []).append((p, own))
            self.tables.append((m, b, m - b + 1, shift, bucket))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The disjoint word ranges [start, end) inside occurrences, and the items that occur."""
        found: list[tuple[int, int]] = []
        items: set = set()
        n = len(words)
        for m, b, far, shift, bucket in self.tables:
            get, end = shift.get, m
            while end <= n:
                block = tuple(words[end - b:end])
                step = get(block, far)
                if step == 0:
                    step = 1
                    start = end - m
                    for p, own in bucket[block].get(words[start], ()):
                        if tuple(words[start:end]) == p:
                            found.append((start, end))
                            items |= own
                end += step
        return merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, max_words: int, window: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of at most ``max_words`` words; a longer item is cut with overlaps, so that no window is lost."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        w = words_of(r.t.encode())
        at = 0
        while at < len(w):
            piece = w[at:at + max(max_words, window)]
            if block and size + len(piece) > max_words:
                yield block
                block, size = [], 0
            block.append((r.i, b" ".join(piece)))
            size += len(piece)
            at += len(piece) if at + len(piece) >= len(w) else len(piece) - window + 1
    if block:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS,
                       hit_share: int = 20, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, items_sha256, hit_starts, hit_ends (word ranges) and
    contaminated (n_hit > 0 and hit_share · n_hit ≥ n_words)."""
    new = ["n_words", "n_hit", "n_items", "items", "items_sha256", "hit_starts", "hit_ends", "contaminated"]
    docs = docs.drop(*[c for c in docs.columns if c in new and c != "text"])
    blocks = item_blocks(benchmark, max_words, window)
    block, out = next(blocks, []), docs
    while True:
        following = next(blocks, None)
        out = _search_pass(out, block, window, last=following is None, hit_share=hit_share, keep_text=keep_text)
        if following is None:
            return out
        out, block = stored(out), following


def _search_pass(df: DataFrame, block, window: int, last: bool, hit_share: int, keep_text: bool) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(block)
    names = df.columns
    plain = [c for c in names if not c.startswith("_") or c not in ("_words", "_starts", "_ends", "_items")]
    if last and not keep_text:
        plain.remove("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in plain)
    tail = ("n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, "
            "hit_starts array<int>, hit_ends array<int>, contaminated boolean") if last else STATE

    def run(batches):
        matcher = Matcher(shipped.value, window)
        for batch in batches:
            # the rows go on in pieces: a batch of very long texts is not held twice
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                before = part.select(["_starts", "_ends", "_items"]).to_pylist() if "_items" in names else None
                counts, starts, ends, items = [], [], [], []
                for k, text in enumerate(to_bytes(part.column(names.index("text")))):
                    words = words_of(text)
                    ranges, own = matcher.search(words)
                    if before is not None:
                        ranges = merged(ranges + list(zip(before[k]["_starts"], before[k]["_ends"])))
                        own |= set(before[k]["_items"])
                    counts.append(len(words))
                    starts.append([a for a, _ in ranges])
                    ends.append([b for _, b in ranges])
                    items.append(sorted(own))
                cols = [part.column(names.index(c)) for c in plain]
                at_list, text_list = pa.list_(pa.int32()), pa.list_(pa.string())
                if last:
                    hits = [sum(e) - sum(s) for s, e in zip(starts, ends)]
                    cols += [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                             pa.array([len(x) for x in items], pa.int64()), pa.array(items, text_list),
                             pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                             pa.array(starts, at_list), pa.array(ends, at_list),
                             pa.array([h > 0 and hit_share * h >= c for h, c in zip(hits, counts)], pa.bool_())]
                    tops = plain + new_names
                else:
                    cols += [pa.array(counts, pa.int64()), pa.array(starts, at_list), pa.array(ends, at_list),
                             pa.array(items, text_list)]
                    tops = plain + ["_words", "_starts", "_ends", "_items"]
                yield pa.RecordBatch.from_arrays(cols, names=tops)

    new_names = ["n_words", "n_hit", "n_items", "items", "items_sha256", "hit_starts", "hit_ends", "contaminated"]
    return df.mapInArrow(run, f"{fields}{', ' if fields else ''}{tail}")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows, columns as they were."""
    names = docs.columns
    plain = docs.select(F.struct(*names).alias("row"), F.col("text"))
    return find_contamination(plain, benchmark).where(~F.col("contaminated")).select("row.*")


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS m, unnest(range(1, CAST(greatest(1, len(w) - 12) AS BIGINT) + 1)) AS i, w FROM b WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p FROM bw),
lens AS (SELECT DISTINCT m FROM pat),
dw AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, lens WHERE len(w) >= m),
occ AS (SELECT dw.doc_id, dw.i, dw.m, pat.item_id FROM dw JOIN pat
  ON pat.m = dw.m AND pat.p = array_to_string(dw.w[dw.i:dw.i + dw.m - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + m)) AS pos FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""
