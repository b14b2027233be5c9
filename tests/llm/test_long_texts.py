"""Texts much longer than a block: the same results as in one piece, in bounded memory."""

import subprocess
import sys

import numpy as np
import pytest

from quarry.llm import bpe, common, hashing, minhash, quality, shingles, suffix_dedup

WORDS = np.array([f"w{i}".encode() for i in range(5000)] + [b"Caf\xc3\xa9,", b"A" * 3000])


def text(seed, n):
    return b" ".join(np.random.default_rng(seed).choice(WORDS, n).tolist()).decode()


@pytest.fixture
def small(monkeypatch):
    """Blocks of a kilobyte, so that every text is long."""
    whole = {}
    texts = ["", "one", text(1, 3000), "x" * 9000, " " * 5000, text(2, 800) + "\n" + "y" * 4000, text(1, 3000)[500:9000]]
    whole["words"] = hashing._words_of([t.encode() for t in texts], shingles.BETWEEN, hashing.LOWER)
    whole["sets"] = list(shingles.shingle_sets(texts))
    whole["features"] = list(quality.features_of(texts))
    monkeypatch.setattr(hashing, "LONG", 1000)
    monkeypatch.setattr(quality, "LONG_TEXT", 64)
    return texts, whole


def test_words_and_sets(small):
    texts, whole = small
    h, counts = hashing.words_of([t.encode() for t in texts], shingles.BETWEEN, hashing.LOWER)
    assert (h == whole["words"][0]).all() and (counts == whole["words"][1]).all()
    assert all((a == b).all() for a, b in zip(shingles.shingle_sets(texts), whole["sets"], strict=True))
    assert all((a == b).all() for a, b in zip(quality.features_of(texts), whole["features"], strict=True))


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_pieces_are_cut_between_words(size):
    t = text(3, 200).encode()
    parts = list(hashing.pieces_of(t, shingles.BETWEEN, size))
    assert b"".join(parts) == t and sum(len(p.split()) for p in parts) == 200


def test_segments_in_pieces_hold_every_window_once():
    group = [text(4, 900).encode(), b"", text(5, 50).encode()]
    whole = {}
    for out, size in ((whole, 10**9), (pieces := {}, 333)):
        for k, at, n, anchor, _ in suffix_dedup.in_pieces(group, size=size):
            for i in range(len(at)):
                for w in range(n[i]):
                    assert (k[i], at[i] + w) not in out
                    out[k[i], at[i] + w] = anchor[i]
    assert whole == pieces and len(whole) == sum(max(0, len(g) - 99) for g in group)


def test_merged_spans():
    rng = np.random.default_rng(1)
    for _ in range(50):
        at = rng.integers(0, 300, 20)
        to = at + rng.integers(1, 20, 20)
        covered = np.zeros(400, bool)
        for x, y in zip(at, to):
            covered[x:y] = True
        a, b = suffix_dedup.merged_spans(at, to)
        mine = np.zeros(400, bool)
        for x, y in zip(a, b):
            assert not mine[x:y].any() and (x == 0 or not covered[x - 1])
            mine[x:y] = True
        assert (mine == covered).all()


@pytest.mark.parametrize("what", ["shingles", "quality", "segments"])
def test_memory_of_a_hundred_megabytes(what):
    """Peak of a process that works through one text of 100 MB."""
    code = f"""
import resource, sys
sys.path.insert(0, {sys.path[0]!r}); sys.path[:0] = {sys.path!r}
import numpy as np
from quarry.llm import quality, shingles, suffix_dedup
letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz      \\n.", np.uint8)
t = letters[np.random.default_rng(0).integers(0, len(letters), 100_000_000, np.uint8)].tobytes().decode()
n = len(t)
if {what!r} == "shingles":
    print(len(next(shingles.shingle_sets([t]))))
elif {what!r} == "quality":
    print(len(next(quality.features_of([t]))))
else:
    print(sum(len(x[0]) for x in suffix_dedup.in_pieces([t.encode()])))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=600).stdout.split()
    assert int(out[1]) > 90_000_000 and float(out[2]) < 1024, out


def test_groups_of_small_blocks(monkeypatch):
    """Results do not depend on the bytes handled at once."""
    texts = ["", "one", *(text(i, 300) for i in range(40)), "x y"]
    sets, features = list(shingles.shingle_sets(texts)), list(quality.features_of(texts))
    monkeypatch.setattr(hashing, "SMALL", 100)
    assert all((a == b).all() for a, b in zip(shingles.shingle_sets(texts), sets, strict=True))
    assert all((a == b).all() for a, b in zip(quality.features_of(texts), features, strict=True))


@pytest.mark.parametrize("set_to", ["64m", "1g", "1000000b"])
@pytest.mark.parametrize("what", ["quality", "minhash", "encode", "digests"])
def test_texts_go_to_python_in_small_batches(spark, what, set_to):
    """A worker holds a few MB of texts at once, whatever the number of rows in a batch; a lower limit stays."""
    before = spark.conf.get(common.BATCH_SETTING)
    spark.conf.set(common.BATCH_SETTING, set_to)
    docs = spark.range(60, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('word', id, ' '), 50000) as text")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    try:
        if what == "quality":
            quality.scored(docs, docs.selectExpr("doc_id", "1 as quality"))
        else:
            {"minhash": minhash.sketched, "encode": bpe.encode, "digests": bpe.digests}[what](docs)
        largest = docs.select("text").mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]
        assert largest < common.BATCH_BYTES + 500_000
        assert set_to != "1000000b" or spark.conf.get(common.BATCH_SETTING) == set_to
    finally:
        spark.conf.set(common.BATCH_SETTING, before)
