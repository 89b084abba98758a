"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from typing import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources.tables import table  # noqa: F401 — the given tables, for the queries

# Bytes of text that one vectorised kernel call works on; a single longer text is a call of its own.
KERNEL_BYTES = 2 << 20
# ASCII white space as the contracts define it: space and 0x09-0x0D
SPACE_TABLE = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
MULT = np.uint64(0x9E3779B97F4A7C15)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared checkpoint folder and read back: it is computed once and
    survives the loss of an executor.  ``session.release`` deletes it once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def slices(column: pa.Array, limit: int = KERNEL_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a binary column that hold about ``limit`` bytes each (one row at least)."""
    n = len(column)
    if n == 0:
        return
    ends = np.cumsum(binary_lengths(column))
    a = 0
    while a < n:
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield a, min(b, n)
        a = min(b, n)


def binary_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def to_bytes(column: pa.Array) -> list[bytes]:
    """A string or binary column as UTF-8 bytes; null becomes empty."""
    if not pa.types.is_large_binary(column.type) and not pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = x ^ (x >> np.uint64(31))
    x = x * MULT
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_starts(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the runs of word bytes; ``is_word`` is a 256-entry boolean table."""
    w = is_word[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], w, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word buf[start:end], computed for all words at once."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inside = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    longest = int(lengths.max())
    power = np.empty(longest, np.uint64)
    p = 1
    for k in range(min(longest, 1 << 12)):
        power[k] = p
        p = p * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    for k in range(1 << 12, longest, 1 << 12):    # longer words: later blocks are multiples of the first
        m = min(1 << 12, longest - k)
        power[k:k + m] = power[:m] * np.uint64(pow(0x100000001B3, k, 1 << 64))
    at = np.repeat(starts, lengths) + inside
    v = (buf[at].astype(np.uint64) + np.uint64(1 + seed)) * power[inside]
    return mix(np.add.reduceat(v, first) + lengths.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``."""
    def run(batches):
        for b in batches:
            yield from fn(b)
    return df.mapInArrow(run, schema)


def repeat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for every (s, n)."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) - np.repeat(first - starts, lengths)
