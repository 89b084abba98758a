"""Packing, ranked search and alignment of tokenisations against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parlance.llm import alignment, byte_bpe, max_sketch, packing

SCHEMA = "doc_id bigint, text string, length int, score string, _n string, part int"   # extra columns with clashing names
TEXTS = ["the cat sat on the mat", "The  CAT, the mat\n\tand the café!", "<|endoftext|> is a string", "naïve 日本語 text 🙂 x", "", None, " ", "a",
         "▁ a sign that B reads as a space", "z\x00y", "end ", " begin", "the cat sat on the mat", "1234567890 12 3", "ﬁn é é"]


def make(seed=3, n=60):
    rng = random.Random(seed)
    words = ["the", "cat", "Sat", "mat,", "café", "x1", "日本", "on", "of", "running", "unhappiness", "zebra", "<s>", "Ünder"]
    rows = [(10 * k, t, 1, "x", None, 7) for k, t in enumerate(TEXTS)]
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 70))), 0, "", "", 0) for k in range(n)]
    return rows + [rows[1], (None, "the zebra", 0, "", "", 0), (None, None, 0, "", "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(), SCHEMA).repartition(3).checkpoint()


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# --- ids ---------------------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_reference_library(text):
    ref = Tokenizer.from_str(DEFINITION)
    assert BPE.ids(text).tolist() == ref.encode(text, add_special_tokens=False).ids


DEFINITION = byte_bpe.read_definition()
BPE = byte_bpe.ByteBpe(DEFINITION)


@pytest.mark.parametrize("text", ["a<|endoftext|>b", " " * 1_000_000, "x" + "\n" * 200_000 + "y", "a" * 200_000, "　" * 120_000 + " b", ""])
def test_special_and_long(text, reference):
    assert BPE.ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids
    plain = byte_bpe.ByteBpe(DEFINITION, special_is_text=True)
    ids = plain.ids(text)
    assert b"".join(plain.tokens[i] for i in ids) == text.encode() and 50256 not in ids


# --- packing -----------------------------------------------------------------------------------------------------------

def check_packing(rows, got, reference, limit):
    want = Counter()
    for i, t, *_ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % limit or limit
        cuts = [0] + list(range(first, len(ids) + 1, limit))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences)


@pytest.mark.parametrize("limit", [8, 64, 1024])
def test_packing(spark, docs, reference, limit):
    got = packing.pack(docs, limit=limit).collect()
    n = check_packing(make(), got, reference, limit)
    assert n <= sum(c for _, c in packing.best_fit(np.bincount([r.length for r in got], minlength=limit + 1), limit, []))


def test_packing_of_nothing_and_of_long_texts(spark, docs, reference):
    assert packing.pack(docs.limit(0)).collect() == []
    rows = [(1, "word " * 40_000), (2, None), (2, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check_packing(rows, got, reference, 1024)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_the_stock_once(seed):
    rng = np.random.default_rng(seed)
    limit = int(rng.integers(1, 200))
    lengths = rng.integers(1, limit + 1, int(rng.integers(0, 3000)))
    if seed % 2:
        lengths = np.minimum(lengths, rng.choice(np.arange(1, limit + 1), 3)[rng.integers(0, 3, len(lengths))])
    stock = np.bincount(lengths, minlength=limit + 1)
    groups = packing.plan(stock, limit)
    used = np.zeros(limit + 1, np.int64)
    for parts, n in groups:
        assert sum(parts) <= limit and n > 0
        for v in parts:
            used[v] += n
    assert (used == stock).all()
    n = sum(c for _, c in groups)
    assert -(-int(lengths.sum()) // limit) <= n <= sum(c for _, c in packing.best_fit(stock, limit, []))


def test_least_squares_reaches_the_histogram():
    stock = np.zeros(101, np.int64)
    stock[[60, 40, 30, 50]] = [500, 600, 200, 300]     # 60+40, 50+50, 40+30+30
    rows = packing.patterns(stock, 100)
    x = packing.nnls(rows, stock)
    use = sum(np.bincount(rows[:, k], weights=x, minlength=101) for k in range(3))
    assert (x >= 0).all() and np.abs(use - stock)[1:].max() < 1
    assert sum(n for _, n in packing.plan(stock, 100)) <= -(-int((stock * np.arange(101)).sum()) // 100) + 101


# --- ranked search ----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda x: x[0].lower(), t or "")


def brute_rank(rows, items, k=10):
    docs = [(i, Counter(TERM.findall(lower(t)))) for i, t, *_ in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    out = []
    for item, text in items:
        q = TERM.findall(lower(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c, _ in docs) + 1))) for t in q}
        scored = []
        for i, c, n in docs:
            m = 25 + (75 * n * n_docs) // total
            s = sum(w[t] * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scored.append((s, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


ITEMS = [(1, "the cat"), (2, "Zebra zebra the"), (3, None), (4, ""), (5, "unknown words"), (6, "日本 CAFÉ café x1 the on of mat"), (1, "the cat"), (None, "running")]


@pytest.mark.parametrize("k, width, max_terms", [(10, 4096, 200_000), (3, 2, 3), (1, 1, 1)])
def test_search_is_the_brute_force_ranking(spark, docs, k, width, max_terms):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = max_sketch.search(docs, items, k=k, width=width, max_terms=max_terms).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=repr) == brute_rank(make(), ITEMS, k)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert max_sketch.search(docs.limit(0), items).collect() == []
    assert max_sketch.search(docs, items.limit(0)).collect() == []
    assert max_sketch.search(docs.where("text IS NULL"), items).collect() == []


@pytest.mark.parametrize("width", [1, 7, 64, 4096])
def test_bounds_hold_and_spare_rescoring(width):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))).encode() for _ in range(500)]
    query = sorted(rng.sample(vocabulary, 6)) + ["absent"]
    v = max_sketch.Vocabulary([t.encode() for t in query])
    part = max_sketch.Slice(texts, v)
    m = 25 + 3 * part.n
    place = np.empty(len(query), np.int64)
    place[v.order] = max_sketch.coordinates(v.hashes, width)
    w = np.arange(len(query), dtype=np.int64) * 100 + 50
    sketch = part.folded(m, width)
    exact = np.zeros(len(texts), np.int64)
    for d, t in enumerate(texts):
        c = Counter(t.decode().split())
        exact[d] = sum(int(x) * ((10 ** 9 * c[q]) // (1000 * c[q] + 8 * int(m[d]))) for q, x in zip(query, w) if q in c)
    assert ((w @ sketch[place]) >= exact).all()
    best = [max_sketch.Best(5)]
    n = max_sketch.rank_slice(part, np.arange(len(texts)), m, sketch, [(np.arange(len(query)), w, place)], len(query), best, chunk=8)
    order = sorted(range(len(texts)), key=lambda d: (-exact[d], d))[:5]
    assert best[0].ids.tolist() == order and best[0].scores.tolist() == exact[order].tolist()
    assert width < 4096 or n < 100


# --- alignment ---------------------------------------------------------------------------------------------------------

def brute_align(rows, reference):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    reference.encode_special_tokens = True
    found, pairs = [], Counter()
    for i, text, *_ in rows:
        tokens = ([], [])
        if text:
            whole = (" " + text).encode()
            a = [(t, BPE.tokens[t]) for t in reference.encode(" " + text, add_special_tokens=False).ids]
            b = [(t, bytes([int(sp.id_to_piece(t)[3:5], 16)]) if sp.is_byte(t) else sp.id_to_piece(t).replace("▁", " ").encode()) for t in sp.encode(text)]
            if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
                tokens = (a, b)
        spans = []
        for side in tokens:
            at, out = 0, []
            for t, raw in side:
                out.append((t, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        a, b = spans
        link = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        start, groups = 0, []
        for c in cuts:
            groups.append("|".join(",".join(str(t) for t, s, e in side if s >= start and e <= c) for side in spans))
            start = c
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        pairs.update(link)
        found.append((i, len(a), len(b), len(groups), sha, link))
    reference.encode_special_tokens = False
    most = Counter()
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return Counter((i, n_a, n_b, g, len(link), sha, sum(pairs[p] == most[p[1]] for p in link), sum(pairs[p] for p in link))
                   for i, n_a, n_b, g, sha, link in found)


@pytest.mark.parametrize("block_bytes", [1, 3000, 16 << 20])
def test_alignment(spark, docs, reference, block_bytes):
    got = alignment.align_tokens(docs, block_bytes=block_bytes).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in got) == brute_align(make(), reference)


def test_alignment_of_nothing_and_of_long_texts(spark, docs, reference):
    assert alignment.align_tokens(docs.limit(0)).collect() == []
    assert {r.n_a for r in alignment.align_tokens(docs.where("text IS NULL")).collect()} == {0}
    rows = [(1, "pneumonoultramicroscopic日本 " * 300), (2, " " * 3000)]
    got = alignment.align_tokens(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in got) == brute_align(rows, reference)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=40), st.data())
def test_pointers_end_at_the_last_token_of_the_group(sizes, data):
    total = sum(sizes)
    cuts = data.draw(st.sets(st.integers(1, total - 1)) if total > 1 else st.just(set()))
    ends_a, ends_b = np.cumsum(sizes), np.array(sorted(cuts | {total}))
    last_a, last_b = alignment.terminals(ends_a, ends_b)
    common = np.intersect1d(ends_a, ends_b)
    for ends, last in ((ends_a, last_a), (ends_b, last_b)):
        assert (ends_a[last] == common[np.searchsorted(common, ends)]).all()
