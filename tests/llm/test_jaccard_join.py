"""The n-gram Jaccard join against all pairs, on small corpora."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_fixture import docs, fixture_rows, no_docs  # noqa: F401 - fixtures
from quarry.llm import jaccard_join, set_pairs

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_components(rows, words=3, percent=90):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        s = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        if d is not None:
            sets[d] = s
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


def test_components(docs, no_docs, fixture_rows):
    out = jaccard_join.similar_components(docs)
    assert got(out) == brute_components(fixture_rows) and out.count() == len(fixture_rows)
    assert {r.component_id for r in out.where("doc_id is null").collect()} == {None}
    assert jaccard_join.similar_components(no_docs).collect() == []


def corpus(seed, copies, length, vocabulary=300):
    """Groups of near copies of several rates of change, chains, shared passages and repeated words."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(3):
        base = [rnd.choice(words) for _ in range(length)]
        chain = list(base)
        for i in range(copies):
            w = list(base)
            for _ in range(rnd.randrange(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            if i % 5 == 0:
                w = w[: len(w) - rnd.randrange(0, 12)]
            if i % 7 == 0:
                at = rnd.randrange(len(chain))
                chain[at] = f"c{i}"
                w = list(chain)
            out.append(" ".join(w))
    return [(100 + i, t) for i, t in enumerate(rnd.sample(out, len(out)))]


@pytest.mark.parametrize("seed, copies, length, words, percent", [(1, 60, 80, 3, 90), (2, 40, 30, 3, 90), (3, 50, 60, 2, 75), (4, 40, 200, 3, 90)])
def test_near_copies(spark, seed, copies, length, words, percent):
    rows = corpus(seed, copies, length)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(jaccard_join.similar_components(d, words, percent)) == brute_components(rows, words, percent)


def test_prefix_group_with_several_members(spark, monkeypatch):
    """Sets that differ behind their prefixes: one group, members compared by their leader."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        w[100] = rnd.choice(["x", "y", "z"])
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_join.similar_components(d)) == brute_components(rows)


def test_text_of_every_size_links_exactly_at_the_limit(spark):
    rows, at = [], 0
    for n in range(1, 60):
        base = [f"a{n}_{i}" for i in range(n)]
        for k in range(0, 4):
            rows += [(at, " ".join(base + [f"b{n}_{i}" for i in range(k)]))]
            at += 1
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_join.similar_components(d)) == brute_components(rows)


def test_verified_pairs_and_texts_of_one_id(spark):
    texts = [(1, "a b c d"), (2, "a b c d"), (2, "x y z"), (3, "x y z"), (4, None), (5, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "a long, b long")
    assert sorted(tuple(r) for r in set_pairs.verified(pairs, d, 3, 90).collect()) == [(1, 2), (2, 3)]


def test_slot_levels(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "A b c d"), (3, None)], "doc_id long, text string").repartition(3)
    levels = jaccard_join.slot_levels(d, 1 << 16)
    assert sorted(levels[levels > 0].tolist()) in ([1, 2], [3])
    assert not jaccard_join.slot_levels(d.where(F.lit(False)), 16).any()
    counts = jaccard_join.level_of(np.arange(100000))
    assert (np.diff(counts.astype(int)) >= 0).all() and counts[128] == 128 and counts.max() < 255


@pytest.mark.parametrize("n, m", [(10, 12), (500, 530), (1020, 1030), (3000, 2800), (1100, 1000)])
def test_profiles_bound_the_difference(spark, n, m):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 1 << 63, n, np.uint64)
    b = np.concatenate([a[:n * 9 // 10], rng.integers(0, 1 << 63, m - n * 9 // 10, np.uint64)])
    size = lambda s: max(jaccard_join.PARTS, 1 << (2 * len(s) // 64).bit_length())
    row = [(jaccard_join.profile(s, size(s)).tolist()) for s in (a, b)]
    df = spark.createDataFrame([tuple(row)], "a array<long>, b array<long>")
    (got,) = df.select(jaccard_join.differing("a", "b")).first()
    true = len(np.setxor1d(a, b))
    assert true * 0.5 < got <= true
