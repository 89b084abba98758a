"""Exact duplicates, near duplicates, repeated passages and decontamination against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.llm import decontaminate, exact_dedup, jaccard_join, substring_dedup

SCHEMA = "doc_id bigint, text string, n_words int, kept string, _words string"   # extra columns with clashing names
WORDS = ["the", "of", "Alpha", "beta", "gamma,", "delta", "épsilon", "zeta x", "eta", "theta.", "iota", "kappa", "la", "mu"]


def make(seed: int, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 90))) for _ in range(8)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            t = rng.choice(base)
        elif kind < 0.6:
            w = rng.choice(base).split(" ")
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            t = rng.choice([" ", "  ", "\n"]).join(w)
        elif kind < 0.8:
            t = " ".join([rng.choice(base), rng.choice(WORDS), rng.choice(base)])
        elif kind < 0.9:
            t = " ".join([rng.choice(WORDS)] * rng.randint(1, 70))
        else:
            t = rng.choice(["", " ", "\n\t", None, "one", "one two"])
        rows.append((i * 3, t, 1, "x", None))
    return rows + [rows[5]] + [(None, base[0], 1, "x", None), (None, None, 1, "x", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(make(1) + [(10_000, " ".join(make(2)[0][1] or "a" for _ in range(300)), 0, "", "")], SCHEMA).repartition(3)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_duplicates(docs):
    want = []
    rows = rows_of(docs)
    for i, t in rows:
        same = [j for j, u in rows if norm(u) == norm(t)]
        keep = min((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    for hash_of in (F.xxhash64, lambda c: F.length(c).cast("long")):       # the second is wrong for most chunks
        got = exact_dedup.exact_duplicates(docs, hash_of).drop("n_chunks").collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_chunks_join_up_and_move_little(spark):
    rng = random.Random(3)
    t = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(5000))
    df = spark.createDataFrame([(t,), ("new words in front " + t,), ("x" * 20_000,), ("",)], "t string")
    cut = [r.c for r in df.select(exact_dedup.chunks(F.col("t")).alias("c")).collect()]
    assert ["".join(c) for c in cut] == [r.t for r in df.collect()]
    assert max(len(x) for c in cut for x in c) <= exact_dedup.MAX_CHARS
    assert len(set(cut[0]) & set(cut[1])) >= len(cut[0]) - 4


def test_drop_exact_duplicates_keeps_columns(docs):
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    texts = [norm(r.text) for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t in rows_of(docs)})


def brute_passages(rows, n=20):
    big = 1 << 62
    order = sorted(rows, key=lambda r: big if r[0] is None else r[0])
    seen, out = {}, []
    for i, t in order:
        key = big if i is None else i
        w = words(t)
        gone = set()
        for k in range(len(w) - n + 1):
            first = seen.setdefault(tuple(w[k:k + n]), (key, k))
            if first != (key, k):
                gone |= set(range(k, k + n))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bucket_bytes", [substring_dedup.BUCKET_BYTES, 200])
def test_repeated_passages(spark, docs, bucket_bytes):
    df = docs.where("doc_id IS NOT NULL")
    got = substring_dedup.repeated_passages(df, bucket_bytes=bucket_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == brute_passages(rows_of(df))


def test_hash_collisions_do_not_remove_words(monkeypatch):
    import numpy as np
    monkeypatch.setattr(substring_dedup, "sequence_hash", lambda w, n: np.full(max(0, len(w) - n + 1), 5, np.uint64))
    w = [f"w{i}" for i in range(30)]
    strings = [" ".join(w).encode(), " ".join(w[5:] + ["x"]).encode()]
    own, first, n = substring_dedup.repeated_windows(strings, np.array([1, 2]), np.array([0, 0]))
    assert list(zip(own, first, n)) == [(1, 0, 6)]


def shingles(t, n=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if s and u and 100 * len(s & u) >= 90 * len(s | u) and find(i) != find(j):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted([(i, len(shingles(t)), None if i is None else find(i)) for i, t in rows], key=repr)


@pytest.mark.parametrize("seed, sub_rows", [(1, 2048), (4, 2)])
def test_near_duplicates(spark, seed, sub_rows):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(8, 150))] for _ in range(6)]
    rows = []
    for i in range(90):                            # chains of small changes around the threshold
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice([[], ["X1"], [w[k], "y"]])
        rows.append((i, " ".join(w)))
        if rng.random() < 0.5:
            base[rng.randrange(len(base))] = w or ["z"]
    rows += [(200, None), (201, ""), (202, "A b"), (203, "a  B"), (204, "a"), (None, rows[0][1]), rows[3]]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, component string").repartition(3)
    got = jaccard_join.near_duplicates(df, sub_rows=sub_rows).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)
    left = jaccard_join.keep_one_of_each(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {c for i, _, c in brute_components(rows) if i is not None} | {None}


def test_linked_pairs_share_a_tile():
    import numpy as np
    rng = np.random.default_rng(0)
    bands = jaccard_join.Bands()
    for size in [9, 10, 11, 13, 14, 17, 18, 22, 30, 55, 90, 200, 501, 1500]:
        for _ in range(40):
            a = rng.integers(0, 1 << 63, size).astype(np.uint64)
            cut = int(rng.integers(0, size // 9 + 1))
            b = np.concatenate((a[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)))
            both = size - cut
            if 100 * both < 90 * (len(a) + len(b) - both):
                continue
            own = np.repeat([0, 1], [len(a), len(b)])
            doc, key = jaccard_join.tile_keys(own, np.concatenate((a, b)), 2, bands)
            if set(a.tolist()) != set(b.tolist()):
                assert set(key[doc == 0].tolist()) & set(key[doc == 1].tolist()), (size, cut, len(b))


def benchmark_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_contamination(rows, items):
    pats = {}
    for i, t in items:
        w = benchmark_words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            pats.setdefault(tuple(w[k:k + m]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w = benchmark_words(t)
        hit, own = set(), set()
        for m in {len(p) for p in pats}:
            for k in range(len(w) - m + 1):
                if (p := tuple(w[k:k + m])) in pats:
                    hit |= set(range(k, k + m))
                    own |= pats[p]
        out.append((i, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_words", [decontaminate.MAX_WORDS, 40])
def test_decontamination(spark, docs, max_words):
    rng = random.Random(9)
    rows = rows_of(docs)
    items = [(k, " ".join((rng.choice(rows)[1] or "").split()[2:2 + rng.randint(1, 50)])) for k in range(12)]
    items += [(50, "iota kappa"), (51, "MU"), (52, ""), (53, None), (None, "épsilon La"), (50, "iota kappa")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = (decontaminate.find_contamination(docs, bench, max_words=max_words)
           .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    want = brute_contamination(rows, items)
    assert sorted(map(tuple, got), key=repr) == want
    if max_words == 40:
        left = decontaminate.drop_contaminated(docs, bench)
        assert left.columns == docs.columns and left.count() == sum(not w[-1] for w in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b c", 0, "", "")], SCHEMA)
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert jaccard_join.near_duplicates(none).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0
    assert decontaminate.find_contamination(none, bench).count() == 0
    r = decontaminate.find_contamination(some, bench).first()
    assert (r.n_words, r.n_hit, r.contaminated, r.items_sha256) == (3, 0, False, hashlib.sha256(b"").hexdigest())
