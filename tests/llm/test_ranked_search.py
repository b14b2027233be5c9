"""Ranked search against scores worked out one by one."""

import math
import random
import re
from collections import Counter

import pytest

from corpus_fixture import docs, fixture_rows, no_docs  # noqa: F401 - fixtures
from quarry.llm import ranked_search

LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_ranking(rows, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in rows]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set((i, t or "") for i, t in items):
        scores = []
        for d, c in counts:
            n = c.total()
            s = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 90 + (90 * n * n_docs) // n_terms
                    s += w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def items(fixture_rows):
    rnd = random.Random(4)
    texts = [t for _, t in fixture_rows if t and t.strip()]
    out = [(i, " ".join(rnd.choice(texts).split()[:rnd.randrange(1, 40)])) for i in range(150)]
    return out + [(150, None), (151, ""), (152, "... !"), (None, out[0][1].upper()), out[3], (4, "one two"), (153, "nowhere-to-be-found zzz"), (154, "é" * 150 + "ß ONE")]


@pytest.fixture(scope="module")
def item_table(spark, items):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id long, text string, term string, block int").repartition(3)


def test_ranking(docs, fixture_rows, item_table, items):
    assert got(ranked_search.ranked(docs, item_table)) == brute_ranking(fixture_rows, items)


def test_ranking_small_blocks_and_waves(docs, fixture_rows, item_table, items, monkeypatch):
    for name, value in (("BUNDLE", 16), ("WAVE", 64), ("OWNERS", (4000, 3000, 1000))):
        monkeypatch.setattr(ranked_search, name, value)
    assert got(ranked_search.search(ranked_search.build_index(docs, 7, 3000), item_table, k=4)) == brute_ranking(fixture_rows, items, 4)


def test_ties_and_copies(spark):
    rows = [(i, "same words here") for i in range(40, 0, -1)] + [(None, "same words here"), (3, "same words here"), (99, "other")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    items = [(1, "Same WORDS"), (2, "other")]
    out = got(ranked_search.ranked(d, spark.createDataFrame(items, "item_id long, text string")))
    assert out == brute_ranking(rows, items) and [r[2] for r in sorted(x for x in out if x[0] == 1)] == [1, 2, 3, 3, 4, 5, 6, 7, 8, 9]


def test_empty(spark, docs, no_docs, item_table):
    assert ranked_search.ranked(no_docs, item_table).collect() == []
    assert ranked_search.ranked(docs, item_table.limit(0)).collect() == []
    blank = spark.createDataFrame([(1, None), (2, " .")], "doc_id long, text string")
    assert ranked_search.ranked(blank, item_table).collect() == []


def test_terms_as_spark_takes_them(spark):
    text = "Ünder_score x1Y2 ÄB\x7fc 😀 \u2028z 9"
    (r,) = ranked_search.item_terms(spark.createDataFrame([(1, text)], "item_id int, text string")).collect()
    assert sorted(r.terms) == sorted(set(terms(text))) == sorted(t.decode() for t in ranked_search.term_counts(text))
