"""Alignment of two tokenisations of the same text (operator 13).

Each text is encoded by a byte-level BPE (A: a space and the text) and by a piece model (B, which adds the space).  Where both
have a token's end, the text is cut into groups; an A and a B token link when their byte ranges overlap.

1. *Groups by pointer jumping.*  Every token points to the farthest-right token that overlaps it: an A token to the B token at its last
   byte if that ends later, else to itself; a B token to the A token at its last byte.  Successors are doubled for all tokens
   of a slice of documents at once, until nothing changes; each token then points to the last A token of its group.
2. *Links.*  The tokens' ends cut a text into segments; each segment is one link.
3. *Counts.*  A task gathers documents into blocks of about ``block_bytes`` of text.  A block keeps, for every document, its links as
   places in the block's table of different id pairs; only that table is shuffled, by pair, to be summed.  The sums, and
   whether a sum is the highest of its B id (one row a B id: the vocabulary bounds that table), come back to the block.

Cases: null or empty text, or one that the tokens' bytes don't give back: no tokens, zeros, groups ''.  Rows are
aligned one by one, so repeated rows and null ids are kept and counted.  No rows: no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .byte_bpe import ByteBpe, read_definition
from .common import repeat_ranges, slices, stored, to_bytes

BLOCK_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def read_pieces(path: str | None = None) -> bytes:
    """The piece model's file; the driver reads it and sends it to the tasks (its size is the vocabulary's)."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


class Pieces:
    def __init__(self, model: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(self.model.id_to_piece(list(range(len(self.model)))))]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A and each B token the number of the last A token of its group; the tokens' ends rise, and the
    last ends are equal."""
    n = len(ends_a)
    later = np.searchsorted(ends_b, ends_a)              # the B token at an A token's last byte
    to_a = np.where(ends_b[later] > ends_a, n + later, np.arange(n)) if n else np.zeros(0, np.int64)
    succ = np.concatenate((to_a, np.searchsorted(ends_a, ends_b)))
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ[:n], succ[n:]
        succ = further


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end of the shared bytes, A token, B token) of every link."""
    ends = np.union1d(ends_a, ends_b)
    return ends, np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Writer:
    """The groups' text form, built for all tokens of a slice from a table of fixed-width pieces."""

    def __init__(self, size_a: int, size_b: int):
        kinds = [(b"%d,", size_a), (b"%d|", size_a), (b"%d,", size_b), (b"%d;", size_b)]
        words = [form % i for form, size in kinds for i in range(size)]
        self.width = max(map(len, words), default=1)
        self.table = np.frombuffer(b"".join(w.ljust(self.width, b"\0") for w in words), np.uint8).reshape(-1, self.width)
        self.a, self.b = size_a, size_b

    def write(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of each token in the groups' order with the sign behind it, whether it ends a B part) as a row a token."""
        n = len(a)
        cut = np.flatnonzero(last_a == np.arange(n))                 # the last A token of each group
        group_a, group_b = np.searchsorted(cut, last_a), np.searchsorted(cut, last_b)
        ends_group = np.ones(len(b), bool)
        ends_group[:-1] = group_b[1:] != group_b[:-1]
        before = np.searchsorted(group_b, np.arange(len(cut)))        # B tokens of earlier groups
        code = np.empty(n + len(b), np.int64)
        code[np.arange(n) + before[group_a]] = a + np.where(last_a == np.arange(n), self.a, 0)
        code[np.arange(len(b)) + cut[group_b] + 1] = 2 * self.a + b + np.where(ends_group, self.b, 0)
        return code, self.table[code]


def align(texts: list[bytes], bpe: ByteBpe, pieces: Pieces, sizes: tuple[np.ndarray, np.ndarray], writer: Writer):
    """(n_a, n_b, n_groups, n_links, groups' hashes, document of each link, its A id, its B id) of some texts."""
    docs = len(texts)
    strings = [t.decode("utf-8", "replace") for t in texts]
    ids_b = pieces.ids(strings)
    ids_a = []
    for k, text in enumerate(texts):
        same = text and b"".join([pieces.tokens[i] for i in ids_b[k]]) == b" " + text
        ids_a.append(bpe.ids(" " + strings[k]) if same else np.zeros(0, np.uint32))
        if not same or int(sizes[0][ids_a[k]].sum()) != len(text) + 1:
            ids_a[k], ids_b[k] = np.zeros(0, np.uint32), []
    n_a, n_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    a = np.concatenate([*ids_a, np.zeros(0, np.uint32)]).astype(np.int64)
    b = np.fromiter(itertools.chain.from_iterable(ids_b), np.int64, int(n_b.sum()))
    if not len(a):
        zero = np.zeros(docs, np.int64)
        return n_a, n_b, zero, zero, [""] * docs, a, a, b
    ends_a, ends_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    last_a, last_b = terminals(ends_a, ends_b)
    owner_a = np.repeat(np.arange(docs), n_a)
    n_groups = np.bincount(owner_a[last_a == np.arange(len(a))], minlength=docs)
    _, of_a, of_b = links(ends_a, ends_b)
    own = owner_a[of_a]
    _, rows = writer.write(a, b, last_a, last_b)
    hashes, at = [], 0
    for n in (n_a + n_b).tolist():
        part = rows[at:at + n].reshape(-1)
        hashes.append(hashlib.sha256(part[part != 0].tobytes()[:-1]).hexdigest() if n else "")
        at += n
    return n_a, n_b, n_groups, np.bincount(own, minlength=docs), hashes, own, a[of_a], b[of_b]


def _blocks(shipped, block_bytes: int, id_type: pa.DataType):
    """Rows of documents (with their links as places in the block's table) and, behind a block's documents, one row with the table."""
    def run(batches):
        from pyspark import TaskContext
        bpe, pieces = ByteBpe(shipped.value[0], special_is_text=True), Pieces(shipped.value[1])
        sizes = tuple(np.array([len(t) for t in x.tokens], np.int64) for x in (bpe, pieces))
        writer = Writer(len(sizes[0]), len(sizes[1]))
        base, number, size, held = TaskContext.get().partitionId() << 32, 0, 0, []

        def flush():
            pairs = np.concatenate([p for _, _, p, _, _ in held])
            table, place = np.unique(pairs, return_inverse=True)
            total = np.bincount(place, weights=np.concatenate([n for _, _, _, n, _ in held]), minlength=len(table)).astype(np.int64)
            at = 0
            for ids, columns, p, n, ends in held:
                mine, at = place[at:at + len(p)].astype(np.int32), at + len(p)
                packed = [zlib.compress(np.diff(mine[x:y], prepend=np.int32(0)).tobytes() + n[x:y].tobytes(), 1) for x, y in zip(ends, ends[1:])]
                rows = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, base + number)), ids, *columns, pa.array(packed, pa.binary()),
                     pa.nulls(rows, pa.list_(pa.int64())), pa.nulls(rows, pa.list_(pa.int64()))], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + number]), pa.nulls(1, id_type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string()),
                 pa.nulls(1, pa.binary()), pa.array([table], pa.list_(pa.int64())), pa.array([total], pa.list_(pa.int64()))], names=names)
        names = ["block", "doc_id", *COLUMNS, "links", "pairs", "times"]
        for batch in batches:
            for x, y in slices(batch.column(1), SLICE_BYTES):
                texts = to_bytes(batch.column(1).slice(x, y - x))
                n_a, n_b, n_groups, n_links, hashes, own, a, b = align(texts, bpe, pieces, sizes, writer)
                pair = (a << 32) + b
                order = np.lexsort((pair, own))
                pair, own = pair[order], own[order]
                first = np.ones(len(pair), bool)
                first[1:] = (pair[1:] != pair[:-1]) | (own[1:] != own[:-1])
                at = np.flatnonzero(first)
                times = np.diff(np.append(at, len(pair))).astype(np.int32)
                ends = np.searchsorted(own[at], np.arange(y - x + 1))
                columns = [*(pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)), pa.array(hashes, pa.string())]
                held.append((batch.column(0).slice(x, y - x), columns, pair[at], times, ends))
                size += sum(map(len, texts))
                if size >= block_bytes:
                    yield from flush()
                    number, size, held = number + 1, 0, []
        if held:
            yield from flush()
    return run


def _weigh(key, docs: pa.Table, sums: pa.Table) -> pa.Table:
    """The documents of a block with the sums of their pairs."""
    place = sums.column("place").to_numpy()
    total, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    total[place], best[place] = sums.column("total").to_numpy(), sums.column("best").to_numpy()
    n_best, count_sum = [], []
    for packed in docs.column("links").to_pylist():
        raw = np.frombuffer(zlib.decompress(packed), np.int32)
        at, times = np.cumsum(raw[:len(raw) // 2]), raw[len(raw) // 2:].astype(np.int64)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int(times @ total[at]))
    out = docs.select(["doc_id", *COLUMNS])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align_tokens(docs: DataFrame, definition: str | None = None, pieces: bytes | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for every row of ``docs(doc_id, text)``."""
    shipped = docs.sparkSession.sparkContext.broadcast((definition or read_definition(), pieces or read_pieces()))
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    numbers = ", ".join(f"{c} bigint" for c in COLUMNS[:4])
    rows = stored(base.mapInArrow(_blocks(shipped, block_bytes, id_type), f"block bigint, doc_id {kind}, {numbers}, groups_sha256 string, "
                                  "links binary, pairs array<bigint>, times array<bigint>"))
    tables = rows.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("place", "e"))
    pairs = tables.select("block", "place", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    sums = pairs.groupBy("pair").agg(F.sum("times").alias("total"))
    b_id = F.col("pair").bitwiseAND(0xFFFFFFFF)
    highest = sums.groupBy(b_id.alias("b")).agg(F.max("total").alias("most"))
    sums = sums.join(F.broadcast(highest), b_id == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    weighed = pairs.select("block", "place", "pair").join(sums, "pair").select(F.col("block").alias("of"), "place", "total", "best")
    texts = rows.where("links IS NOT NULL").select("block", "doc_id", *COLUMNS, "links")
    return (texts.groupBy("block").cogroup(weighed.groupBy("of"))
            .applyInArrow(_weigh, f"doc_id {kind}, {numbers}, groups_sha256 string, n_best bigint, count_sum bigint"))
