import random

import pytest
import tokenizers

from quarry.llm import bpe


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_vocabulary()
    return bpe.WordBPE(path), tokenizers.Tokenizer.from_file(path)


def same(pair, text):
    mine, theirs = pair
    want = theirs.encode(text, add_special_tokens=False).ids
    got = mine.encode(text)
    assert got == want, text
    assert mine.decode(got) == theirs.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "Hello, World! it's we'll THEY'RE 1234", "a<|startoftext|>b <|endoftext|>", "x\x1cy\x1f z\x85w v　u",
    "ΟΔΟΣ Σ İstanbul ẞ é Å", "café naïve 你好 नमस्ते \U0001f600\U0001f468‍\U0001f469", "a" * 5000,
    "́ x    \x00\x01 ﻿ ­", "<|startoftext|><|startoftext|", "!!!???### $$$%%%&&&***"])
def test_cases(pair, text):
    same(pair, text)


def test_random_text(pair):
    rnd = random.Random(5)
    pools = ["abcdefghijklmnopqrstuvwxyz  ", "ABC'sdtmrelv  1 2", "éüñçßÉ ab ", "你好бдΣσ ١ ", "!?#$%&*|.,;:<>/ ",
             "".join(map(chr, range(0x20, 0x250)))]
    for _ in range(2000):
        pool = rnd.choice(pools) + rnd.choice(pools)
        same(pair, "".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 80))))


def test_long_words_and_heap(pair):
    rnd = random.Random(6)
    for n in (33, 200, 3000):
        same(pair, "".join(rnd.choice("abcdeinthgr") for _ in range(n)))


def test_cuts_are_safe(pair):
    """Every fragment alone gives what the whole word gives."""
    mine, _ = pair
    rnd = random.Random(7)
    cut = 0
    for _ in range(300):
        word = [rnd.randrange(256) for _ in range(rnd.randrange(2, 20))]
        word[-1] += 256
        parts = mine.cuts(word)
        cut += len(parts) - 1
        assert sum(parts, []) == word
        assert sum((mine.merged(p) for p in parts), []) == mine.merged(word)
    assert cut


def test_documents(spark, pair):
    rows = [(1, "Hello World", "extra"), (2, None, None), (3, "", "x"), (None, "tie tie", "y"), (1, "Hello World", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.digests(docs).collect()
    assert len(out) == 5 and out[0] == out[4] and out[1].n_tokens == out[2].n_tokens == 0
    back = bpe.decode(bpe.encode(docs)).collect()
    assert back[0].text == pair[1].decode(pair[1].encode("Hello World").ids, skip_special_tokens=False)
    assert back[1].text == ""
    assert bpe.digests(docs.limit(0)).count() == 0


def test_full_memo_tables_change_nothing(pair, monkeypatch):
    ours, theirs = pair
    for name, value in (("CHUNKS", 5), ("FRAGMENTS", 3), ("LONG_KEY", 8)):
        monkeypatch.setattr(bpe, name, value)
    fresh = bpe.WordBPE(bpe.default_vocabulary())
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefgqxz.-é1") for _ in range(rnd.randrange(1, 30))) for _ in range(60)]
    for _ in range(40):
        text = " ".join(rnd.choice(words) for _ in range(30))
        assert fresh.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    assert len(fresh.chunks) <= 5 and len(fresh.older_chunks) <= 5 and len(fresh.fragments) <= 3


def test_memo_tables_hold_each_id_once(pair):
    """Entries of the tables share the ids' objects: an id takes no memory of its own in each entry."""
    fresh = bpe.WordBPE(bpe.default_vocabulary())
    rnd = random.Random(8)
    for _ in range(300):
        same((fresh, pair[1]), " ".join("".join(rnd.choice("abcdefghinrst-é1") for _ in range(rnd.randrange(1, 20))) for _ in range(20)))
    held = [i for table in (fresh.chunks, fresh.fragments) for ids in table.values() for i in ids]
    assert len(held) > 3 * len(set(held)) and len({id(i) for i in held}) == len(set(held))


def test_workers_give_up_memo_tables_after_a_task(spark):
    """A reused Python worker goes on to other work without the tables of its BPE tasks."""
    path = bpe.default_vocabulary()
    rows = [(i, f"words{i} of-document {i}é") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def held(batches):
        t = bpe.tokenizer(path)
        n = sum(map(len, (t.chunks, t.older_chunks, t.fragments, t.older_fragments)))
        for b in batches:
            yield b.assign(id=n)

    for run in (bpe.digests, bpe.encode):
        assert run(docs).collect()
        assert {r.id for r in spark.range(64).repartition(16).mapInPandas(held, "id long").collect()} == {0}
