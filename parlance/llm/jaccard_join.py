"""Near duplicates by exact Jaccard similarity of word n-grams (operator 7).

A document's set holds the 64-bit hashes of its distinct 3-word shingles.  Two documents link when
100 · |A ∩ B| ≥ 90 · |A ∪ B|, so linked sets differ in at most min(|A|, |B|) / 9 shingles.

1. *Tiles.*  Sizes fall into bands (factor 1.25).  A band deals the hash space into more slices than
   the largest difference a linked pair of it can have, so a linked pair agrees on one whole slice at
   least, by the pigeonhole principle; a few slices more allow slices of two shingles or fewer to be
   left out.  Each (band, slice, content of the slice) is a tile; documents at the upper end of a band
   are dealt in the next one as well.  Documents that share a tile are joined into blocks by contraction: rounds
   in which every document has one edge, to the smallest document of its tiles.
2. *Blocks.*  Only documents in a block of several are read again, one for each different set.  A block
   is split by a hash into sub-blocks of bounded size, and each pair of sub-blocks is one task's work:
   rows sorted by size meet only rows within the size bound; the bits of the hashed bitmaps that one
   has and the other lacks bound the overlap from above; what is left is intersected exactly.  Pairs
   that are connected already are not compared.
3. The links' connected components are the classes.

Cases: null or empty text, or no word: empty set, linked with nothing.  Null ``doc_id``: linked with
nothing, component null.  Repeated rows: each gets the component of its doc_id; of rows with one id and
different texts, all sets count for that id.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import release
from .common import mix, slices, stored, to_bytes, word_hashes, word_starts
from .substring_dedup import IS_WORD, mapped, sequence_hash

N, PERCENT = 3, 90
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
SUB_ROWS, SUB_SHINGLES = 2048, 2_000_000
WEAK = 2                  # slices of so few shingles say little


class Bands:
    """Lower size limits of the bands, slices of each, and how many weak slices it can do without."""

    def __init__(self, percent: int = PERCENT, growth: float = 1.25, largest: int = 1 << 40):
        self.percent = percent
        limits = [1]
        while limits[-1] <= largest:
            limits.append(max(limits[-1] + 1, int(limits[-1] * growth)))
        self.limits = np.array(limits, np.int64)
        # |A ∪ B| - |A ∩ B| is at most so much for the smaller size m: m / (p/100) - m, rounded down
        difference = ((100 - percent) * (self.limits[1:] - 1)) // percent
        self.spare = difference // 12 + 1
        self.slices = np.where(difference > 0, difference + 1 + self.spare, 1)
        self.spare = np.where(difference > 0, self.spare, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.limits, sizes, side="right") - 1

    def reaches_next(self, sizes: np.ndarray) -> np.ndarray:
        return 100 * sizes >= self.percent * self.limits[self.of(sizes) + 1]


def shingle_sets(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of the distinct shingles of each text, sorted by both."""
    buf = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    starts, ends = word_starts(buf, IS_WORD)
    first = np.searchsorted(starts, offsets)
    counts = np.diff(np.append(first, len(starts)))
    owner = np.repeat(np.arange(len(texts)), counts)
    words = word_hashes(buf, starts, ends)
    h = sequence_hash(words, n)
    inner = owner[:len(h)] == owner[n - 1:] if len(h) else np.zeros(0, bool)
    own, h = owner[:len(h)][inner], h[inner]
    few = [(d, sequence_hash(words[first[d]:first[d] + counts[d]], int(counts[d]))[0] ^ np.uint64(counts[d]))
           for d in np.flatnonzero((counts > 0) & (counts < n))]
    if few:
        own = np.concatenate((own, np.array([d for d, _ in few], own.dtype)))
        h = np.concatenate((h, np.array([v for _, v in few], np.uint64)))
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return own[new], h[new]


def tile_keys(own: np.ndarray, h: np.ndarray, docs: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(text number, tile key) of every tile that each of the sets belongs to."""
    sizes = np.bincount(own, minlength=docs)
    out_doc, out_key = [], []
    band_of = np.where(sizes > 0, bands.of(np.maximum(sizes, 1)), 0)
    for next_one in (0, 1):
        band = band_of + next_one
        use = (sizes > 0) & (bands.slices[band] > 1)
        if next_one:
            use &= bands.reaches_next(np.maximum(sizes, 1))
        count = np.where(use, bands.slices[band], 0)
        base = np.cumsum(count) - count
        mine = use[own]
        if not mine.any():
            continue
        o, v = own[mine], mix(h[mine] + np.uint64(0x51ED270B))
        at = base[o] + ((v >> np.uint64(32)) * count[o].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(int(count.sum()), np.uint64)
        np.add.at(content, at, v)
        filled = np.bincount(at, minlength=len(content))
        doc = np.repeat(np.arange(docs), count)
        weak = filled <= WEAK
        emit = ~weak | (np.bincount(doc, weights=weak, minlength=docs) > bands.spare[band])[doc]
        number = np.arange(len(content)) - base[doc]
        key = mix(content ^ mix((band[doc].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1)))
        out_doc.append(doc[emit])
        out_key.append(key[emit])
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out_key)


def _sets(bands: Bands):
    """(doc_id, text) → size and 128-bit digest of the set, and its tiles."""
    def run(batch: pa.RecordBatch):
        for a, b in slices(batch.column(1)):
            own, h = shingle_sets(to_bytes(batch.column(1).slice(a, b - a)))
            counts = np.bincount(own, minlength=b - a)
            d1, d2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            np.add.at(d1, own, mix(h + np.uint64(11)))
            np.add.at(d2, own, mix(h ^ np.uint64(0xD6E8FEB86659FD93)))
            doc, key = tile_keys(own, h, b - a, bands)
            key = key[np.argsort(doc, kind="stable")]
            ends = np.append(0, np.cumsum(np.bincount(doc, minlength=b - a))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))], names=["doc_id", "n_shingles", "d1", "d2", "tiles"])
    return run


def _shared(rows: DataFrame) -> DataFrame:
    """``rows(tile, id)`` of the tiles with several ids, with the smallest of them as ``least``."""
    spans = rows.groupBy("tile").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("tile", "least")
    return rows.join(spans, "tile")


def _roots(parent: DataFrame) -> DataFrame:
    """``parent(id, to)``, to ≤ id and itself an id: each id with the end of its chain, by doubling."""
    while True:
        step = stored(parent.join(parent.select(F.col("id").alias("to"), F.col("to").alias("far")), "to"))
        release(parent)
        parent = stored(step.select("id", F.col("far").alias("to")))
        done = step.where("to != far").isEmpty()
        release(step)
        if done:
            return parent


def contracted(rows: DataFrame) -> DataFrame:
    """(id, block) of every id of ``rows(tile, id)`` that shares a tile: the smallest id reachable over shared tiles.

    A round gives every id one edge, to the smallest id of its tiles, follows the edges to their ends and renames the
    ids in the tiles; tiles with one name left go.  So there are at most as many edges as ids, however many
    tiles a group shares."""
    blocks = None
    while True:
        now = stored(_shared(rows))
        if now.isEmpty():
            if blocks is None:
                return now.select("id", F.col("id").alias("block"))
            release(now)
            return blocks
        to = _roots(stored(now.groupBy("id").agg(F.min("least").alias("to"))))
        if blocks is None:
            blocks = stored(to.select("id", F.col("to").alias("block")))
        else:
            before, names = blocks, to.select(F.col("id").alias("block"), "to")
            blocks = stored(before.join(names, "block", "left").select("id", F.coalesce("to", "block").alias("block")))
            release(before)
        rows = stored(now.join(to, "id").select("tile", F.col("to").alias("id")).distinct())
        release(now, to)


def _arrays(batch: pa.RecordBatch):
    """(block, doc_id, parts, text) → the same with the sorted set instead of the text."""
    for a, b in slices(batch.column(3)):
        own, h = shingle_sets(to_bytes(batch.column(3).slice(a, b - a)))
        ends = np.append(0, np.cumsum(np.bincount(own, minlength=b - a))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(k).slice(a, b - a) for k in range(3)), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))],
            names=["block", "doc_id", "parts", "shingles"])


def bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((len(sets), bits // 64), np.uint64)
    for k, s in enumerate(sets):
        at = (s >> np.uint64(7)) & np.uint64(bits - 1)
        np.bitwise_or.at(out[k], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def forest(ids: list[int], sets: list[np.ndarray], side: np.ndarray | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; with ``side`` only links between different sides count."""
    if len(ids) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    side = side[order] if side is not None else None
    bits = 256
    while bits < 2 * sizes[-1]:
        bits *= 2
    maps = bitmaps([sets[k] for k in order], bits)
    group = np.arange(len(ids))
    out = []
    ends = np.searchsorted(sizes, (100 * sizes) // percent, side="right")   # the size bound
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, ends[i])
        if side is not None:
            j = j[side[j] != side[i]]
        j = j[group[j] != group[i]]
        while len(j):
            part, j = j[:4096], j[4096:]
            part = part[group[part] != group[i]]
            lacking = np.bitwise_count(maps[i] & ~maps[part]).sum(axis=1, dtype=np.int64)
            bound = sizes[i] - lacking
            part = part[100 * bound >= percent * (sizes[i] + sizes[part] - bound)]
            for k in part:
                if group[k] != group[i]:
                    both = len(np.intersect1d(sets[order[i]], sets[order[k]], assume_unique=True))
                    if 100 * both >= percent * (sizes[i] + sizes[k] - both):
                        out.append((ids[order[i]], ids[order[k]]))
                        group[group == group[k]] = group[i]
    return out


def _compare(percent: int):
    def run(key, table):
        ids, sets, part = [], [], []
        lo, hi = key[1].as_py(), key[2].as_py()
        for b in table.to_batches():
            ids += b.column("doc_id").to_pylist()
            part += b.column("part").to_pylist()
            column = b.column("shingles")
            values, at = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            sets += [values[x:y] for x, y in zip(at[:-1], at[1:])]
        links = forest(ids, sets, np.array(part) if lo != hi else None, percent)
        return pa.Table.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())],
                                         names=["src", "dst"])
    return run


def near_duplicates(docs: DataFrame, percent: int = PERCENT, sub_rows: int = SUB_ROWS,
                    sub_shingles: int = SUB_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    known = base.where("doc_id IS NOT NULL")
    sets = stored(mapped(base, _sets(Bands(percent)), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, tiles array<bigint>"))
    sizes = sets.drop("tiles")
    own = sizes.where("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets: the smallest id stands for all of them
    same = own.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    tiles = _shared(sets.where("doc_id IS NOT NULL").select(F.explode("tiles").alias("tile"), F.col("doc_id").alias("id")))
    blocks = contracted(tiles.select("tile", "id").join(same.select(F.col("rep").alias("id")), "id", "left_semi").distinct())
    blocks = blocks.withColumnRenamed("id", "rep")
    members = stored(same.join(blocks, "rep").select("block", F.col("rep").alias("doc_id"), "n_shingles"))
    split = (members.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_shingles").alias("total")).where("rows > 1")
             .select("block", F.greatest(F.ceil(F.col("rows") / sub_rows), F.ceil(F.col("total") / sub_shingles)).cast("int").alias("parts")))
    dealt = members.join(split, "block").select("block", "doc_id", "parts")
    # the members grow with the corpus: the texts are joined by a sort at every size
    arrays = mapped(known.join(dealt.hint("merge"), "doc_id").select("block", "doc_id", "parts", "text").dropDuplicates(["doc_id", "text"]),
                    _arrays, "block bigint, doc_id bigint, parts int, shingles array<bigint>")
    mine = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    pairs = (arrays.withColumn("part", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("block", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "doc_id", "part", "shingles"))
    links = stored(pairs.groupBy("block", "lo", "hi").applyInArrow(_compare(percent), "src bigint, dst bigint"))
    # rows of one doc_id, and rows of one set, belong together
    joined = own.join(same, ["d1", "d2", "n_shingles"]).select("doc_id", "rep").where("doc_id != rep")
    twice = own.groupBy("doc_id").agg(F.count_distinct("d1", "d2", "n_shingles").alias("n")).where("n > 1").select("doc_id")
    ids = own.select("doc_id").join(twice, "doc_id", "left_semi")
    links = links.unionByName(joined.join(ids, "doc_id", "left_semi").select(F.col("rep").alias("src"), F.col("doc_id").alias("dst")))
    ends = links.select("src").union(links.select("dst")).select(F.col("src").alias("id")).distinct()
    found = connected_components(ends, links).select(F.col("id").alias("rep"), "component")
    out = (sizes.join(same, ["d1", "d2", "n_shingles"], "left").join(found, "rep", "left"))
    return out.select("doc_id", "n_shingles",
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; rows without an id stay."""
    lost = near_duplicates(docs, percent).where("component_id != doc_id").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, F.col("doc_id") == F.col("_lost"), "left_anti")


ORACLE = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (
  SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) c ON c.id = d.doc_id"""
