"""Licence notices in documents (operator 5).

Winnowed fingerprints: of each two consecutive word pairs the one with the smaller hash is a fingerprint,
so a document and a template that share three words in a row share a fingerprint.  The fingerprints of all
templates are an inverted index; a document's fingerprints that occur in it propose (template, place)
pairs, and only there is the template aligned with the words around, in a band.  The alignment gives the
template words that are covered and where the notice begins and ends.  Of matches that overlap, the one
with more matched words stands.

Cases: null or empty text has no match.  A template of fewer than three words is not searched.  Repeated
rows are searched one by one.  Other columns are not read.
"""

from __future__ import annotations

from typing import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, to_bytes, word_hashes, word_starts
from .decontaminate import WORD_TABLE, words_of
from .substring_dedup import sequence_hash

MIN_COVERAGE = 0.8
#: Short public notices of common licences, and the lines that head their full texts.  Any other set can be passed.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                  "License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                      "documentation files (the \"Software\"), to deal in the Software without restriction",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                          "the following conditions are met",
    "lgpl": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
                   "Public License as published by the Free Software Foundation",
    "lgpl-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl-2.1-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                   "Public License as published by the Free Software Foundation",
    "agpl-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl-2-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                       "REPRODUCTION, AND DISTRIBUTION",
    "mpl-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                      "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-2.0-text": "Mozilla Public License Version 2.0 1. Definitions",
    "isc": "Released under the ISC License.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                      "granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "cc0-1.0": "Licensed under CC0 1.0.",
    "cc0-1.0-header": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc0-1.0-text": "Creative Commons Legal Code CC0 1.0 Universal",
}
IS_WORD = np.array([c != 0x20 for c in WORD_TABLE])


def winnowed(pairs: np.ndarray) -> np.ndarray:
    """Positions of the smaller of each two consecutive hashes; a single hash is its own."""
    if len(pairs) < 2:
        return np.arange(len(pairs))
    left = pairs[:-1] <= pairs[1:]
    return np.unique(np.where(left, np.arange(len(left)), np.arange(1, len(pairs))))


class Index:
    def __init__(self, templates: Mapping[str, str]):
        self.words = {k: w for k, t in templates.items() if len(w := words_of(t.encode())) >= 3}
        entries = []
        for name, w in self.words.items():
            flat = np.frombuffer(b" ".join(w), np.uint8)
            pairs = sequence_hash(word_hashes(flat, *word_starts(flat, IS_WORD)), 2)
            entries += [(int(pairs[i]), name, int(i)) for i in winnowed(pairs)]
        entries.sort()
        self.hashes = np.array(sorted({h for h, _, _ in entries}), np.uint64)
        self.places: dict[int, list[tuple[str, int]]] = {}
        for h, name, i in entries:
            self.places.setdefault(h, []).append((name, i))


def aligned(template: list[bytes], words: list[bytes], band: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment of the whole template within ``words``, whose middle
    diagonal is at ``band``; an edit costs a third of a match, words before and after are free."""
    m, width = len(template), 2 * band + 1
    # score, matched, first matched word, end behind the last matched word; column d is word i + d
    row: list[tuple] = [(0.0, 0, -1, -1)] * width
    best = (0.0, 0, -1, -1)
    for i in range(m):
        new: list[tuple] = []
        for d in range(width):
            j = i + d
            s, k, a, b = row[d]
            if j < len(words) and template[i] == words[j]:
                cell = (s + 1, k + 1, a if a >= 0 else j, j + 1)
            else:
                cell = (s - 1 / 3, k, a, b)
            if d + 1 < width:                       # a template word is missing
                s, k, a, b = row[d + 1]
                cell = max(cell, (s - 1 / 3, k, a, b))
            if d:                                   # an extra word
                s, k, a, b = new[d - 1]
                cell = max(cell, (s - 1 / 3, k, a, b))
            new.append(cell)
        row = new
    best = max(best, *row)
    return best[1], best[2], best[3]


def matches(words: list[bytes], hits: list[tuple[int, int]], index: Index, min_coverage: float) -> list[tuple[str, int, int, int]]:
    """(template, matched, first word, end word) from the (hash, place) hits of one document."""
    found = set()
    tried = set()
    for h, at in hits:
        for name, i in index.places[h]:
            template = index.words[name]
            band = max(2, len(template) // 8)
            corner = at - i
            if any((name, c) in tried for c in range(corner - 1, corner + 2)):
                continue                           # a neighbour diagonal has been aligned
            tried.add((name, corner))
            lo = corner - band
            region = words[max(0, lo):corner + len(template) + band]
            k, a, b = aligned(template, [b""] * max(0, -lo) + region, band)
            if k >= min_coverage * len(template):
                found.add((name, k, lo + a, lo + b))
    out: list[tuple[str, int, int, int]] = []
    for name, k, a, b in sorted(found, key=lambda f: (-f[1], -f[1] / len(index.words[f[0]]), f[0], f[2])):
        if all(b <= x or a >= y for _, _, x, y in out):
            out.append((name, k, a, b))
    return sorted(out, key=lambda f: f[2])


def scan(docs: DataFrame, templates: Mapping[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, template, matched_words, coverage, start_word, end_word, start_char, end_char), a row a match."""
    templates = dict(TEMPLATES if templates is None else templates)
    kind = dict(docs.dtypes)["doc_id"]
    fields = ["doc_id", "template", "matched_words", "coverage", "start_word", "end_word", "start_char", "end_char"]

    def run(batches):
        index = Index(templates)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for a, b in slices(column):
                texts = to_bytes(column.slice(a, b - a))
                buf = np.frombuffer(b"\n".join(texts).translate(WORD_TABLE), np.uint8)
                offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
                starts, ends = word_starts(buf, IS_WORD)
                pairs = sequence_hash(word_hashes(buf, starts, ends), 2)
                at = winnowed(pairs)
                if not len(at) or not len(index.hashes):
                    continue
                k = np.minimum(np.searchsorted(index.hashes, pairs[at]), len(index.hashes) - 1)
                hit = at[index.hashes[k] == pairs[at]]
                first = np.searchsorted(starts, offsets)
                owner = np.searchsorted(first, hit, side="right") - 1
                rows = [[] for _ in fields]
                for d in np.unique(owner):
                    words = words_of(texts[d])
                    own = [(int(pairs[h]), int(h - first[d])) for h in hit[owner == d]]
                    for name, n, x, y in matches(words, own, index, min_coverage):
                        # positions of the notice in characters
                        begin, end = int(starts[first[d] + x] - offsets[d]), int(ends[first[d] + y - 1] - offsets[d])
                        chars = len(texts[d][:begin].decode())
                        for r, v in zip(rows, (ids[a + int(d)].as_py(), name, n, n / len(index.words[name]), x, y,
                                               chars, chars + len(texts[d][begin:end].decode()))):
                            r.append(v)
                types = [ids.type, pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=fields)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, template string, matched_words int, coverage double, start_word int, end_word int, start_char bigint, end_char bigint")
