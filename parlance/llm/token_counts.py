"""Tokens of each field and section of a document (operator 6).

A document's fields are written one after another, a line break between them, and encoded once as a whole;
so the counts add up to the count of the whole.  Byte-level tokens are pieces of the text: their
lengths, summed up, are their offsets.  The spans are joined with the sections' spans by binary search.
A section is a field, or each line of a field that is split into lines; the line break behind a section
belongs to it.  A token that crosses a boundary goes to

* ``first``: the section of its first byte,   * ``last``: that of its last byte,
* ``most``: the one that holds most of its bytes, the first of several (the default),
* ``split``: all of them, by their shares of its bytes.

The vocabulary's path is a parameter; the driver reads the file and sends it (its size is the tokenizer's).  Special tokens'
strings are plain text; a text with very long runs of white space is encoded by the slower library, with the same ids.
Cases: null counts as an empty field; every field has one section at least.  Repeated rows are counted one by one.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, read_definition
from .common import to_bytes

FIELDS = (("source", False), ("lang", False), ("text", True))     # (column, split into lines)
RULES = ("first", "last", "most", "split")


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section; section s covers the bytes bounds[s]:bounds[s + 1]."""
    n = len(bounds) - 1
    a = np.searchsorted(bounds, starts, side="right") - 1
    b = np.searchsorted(bounds, ends - 1, side="right") - 1
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float)
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float)
    inside = a == b
    out = np.bincount(a[inside], minlength=n).astype(float)
    for s, e, x, y in zip(starts[~inside], ends[~inside], a[~inside], b[~inside]):    # the few that cross
        held = np.minimum(bounds[x + 1:y + 2], e) - np.maximum(bounds[x:y + 1], s)
        if rule == "most":
            out[x + int(held.argmax())] += 1
        else:
            out[x:y + 1] += held / (e - s)
    return out


def count_tokens(docs: DataFrame, fields: Sequence[tuple[str, bool]] = FIELDS, rule: str = "most",
                 vocabulary: str | None = None) -> DataFrame:
    """(doc_id, field, section, start_char, end_char, n_tokens), a row a section; positions are code points of
    the field, section counts from 0 in each field."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    shipped = docs.sparkSession.sparkContext.broadcast(read_definition(vocabulary))
    kind = dict(docs.dtypes)["doc_id"]
    names = [c for c, _ in fields]
    split = [s for _, s in fields]
    columns = docs.select("doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f{k}") for k, c in enumerate(names)])

    def run(batches):
        bpe = ByteBpe(shipped.value, special_is_text=True)
        length = np.array([len(t) for t in bpe.tokens], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield sections(part.column(0), [to_bytes(part.column(k + 1)) for k in range(len(names))], bpe, length)

    def sections(ids, texts, bpe, length):
        rows, field, number, first, last, tokens = [], [], [], [], [], []
        for k, values in enumerate(zip(*texts)):
            whole = b"\n".join(values)
            raw = np.frombuffer(whole, np.uint8)
            bounds, own, num = [], [], []
            at = 0
            for f, v in enumerate(values):
                breaks = [0]
                if split[f]:
                    breaks += [int(x) + 1 for x in np.flatnonzero(raw[at:at + len(v)] == 10) if x + 1 < len(v)]
                bounds += [at + x for x in breaks]
                own += [f] * len(breaks)
                num += range(len(breaks))
                at += len(v) + 1
            bounds = np.array(bounds + [len(whole)])
            ends = np.cumsum(length[bpe.ids(whole.decode())])
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            n = allocate(starts, ends, bounds, rule) if len(ends) else np.zeros(len(own))
            chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
            base = np.array([bounds[own.index(f)] for f in own])
            limit = base + np.array([len(values[f]) for f in own])
            rows += [k] * len(own)
            field += [names[f] for f in own]
            number += num
            first += (chars[np.minimum(bounds[:-1], limit)] - chars[base]).tolist()
            last += (chars[np.minimum(bounds[1:], limit)] - chars[base]).tolist()
            tokens += n.tolist()
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows, pa.int64())), pa.array(field, pa.string()), pa.array(number, pa.int32()), pa.array(first, pa.int64()),
             pa.array(last, pa.int64()), pa.array(tokens, pa.float64())],
            names=["doc_id", "field", "section", "start_char", "end_char", "n_tokens"])

    return columns.mapInArrow(run, f"doc_id {kind}, field string, section int, start_char bigint, end_char bigint, n_tokens double")
