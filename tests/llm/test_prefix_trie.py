"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quarry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth string, m long"


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    for c in convs:
        convs[c].sort()
    members, ends = defaultdict(set), defaultdict(set)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        s = c - c % 100
        path = [x[3:] for x in convs.get(s, [])[:h] + own[h:]]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].add(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 5) for r in rows], SCHEMA).repartition(5)


def conversations(seed, n, longest):
    rnd = random.Random(seed)
    texts = ["", "a", "b", "é😀", "long text " * 20, None]
    out = []
    for c in rnd.sample(range(300), n):
        for turn in range(rnd.choice([1, 2, 3, 7, longest])):
            out.append((c, turn * 2, rnd.choice(["user", "assistant", None]) if turn > 2 else "user", rnd.choice(texts[:2] if turn < 4 else texts)))
    return out


@pytest.mark.parametrize("seed, n, longest", [(1, 120, 12), (2, 40, 150)])
def test_trie(spark, seed, n, longest):
    rows = conversations(seed, n, longest)
    same = [(c, t, r, x) for c in (400, 417, 431) for _, t, r, x in rows[:6]]
    odd = [(None, 1, "user", "no id"), (7, None, None, None), (7, None, "z", "first"), (7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, "user", "eit")]
    rows += same + odd + rows[:9]
    assert got(prefix_trie.trie(frame(spark, rows))) == brute_trie(rows)


def test_copies_of_one_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c, t, "user", f"t{t}") for c in range(0, 6000, 20) for t in range(3)]
    out = prefix_trie.trie(frame(spark, rows))
    assert got(out) == brute_trie(rows)


@pytest.mark.parametrize("height", [2, 3])
def test_many_bands(spark, monkeypatch, height):
    monkeypatch.setattr(prefix_trie, "HEIGHT", height)
    rows = conversations(5, 30, 25)
    assert got(prefix_trie.trie(frame(spark, rows))) == brute_trie(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie.trie(frame(spark, [])).collect() == []
    assert prefix_trie.trie(frame(spark, [(None, 1, "user", "x")])).collect() == []
    rows = [(3, 1, "user", "x")]  # no conversation 0, and fewer turns than h
    assert got(prefix_trie.trie(frame(spark, rows))) == brute_trie(rows)
