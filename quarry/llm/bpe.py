"""BPE encoding and decoding with forced-boundary splitting.

A vocabulary token is a run of bytes. If a pair of neighbouring bytes occurs
inside no token at all, no merge can ever join them, so the text may be cut
there: the fragments are encoded independently and their ids concatenated. The
result is that of merging the whole word. (A word's last byte is a symbol of
its own, since the vocabulary marks word ends.)

The vocabulary file (``tokenizers`` JSON, BPE with word ends) is a parameter;
it is read by each task once, and its normaliser, splitter and special tokens
are followed: NFC, white space to one space, lower case, words by script class,
special tokens matched in the raw text. Fragments and words are memoised in
bounded tables of two generations, so a repeated word costs one look-up and
frequent ones stay when a table is full; the ids in them are packed, two bytes
each. A task empties its tables when it ends. Documents are encoded where they are scanned: no shuffle, any
text length, whole texts.

Defined results: a null text is the empty text, with no ids; it decodes to the
empty text. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_small_batches

# White space of Unicode (property White_Space), which the normaliser folds.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"  # as in a character class
#: Entries of a memo table; a full one becomes the older one, whose entries are taken over when they are met again.
CHUNKS, FRAGMENTS = 1 << 18, 1 << 17
LONG_KEY = 64  # characters; longer words are not remembered
ODD_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split only
WORD_END = "</w>"
NEVER = 1 << 60


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: visible Latin-1 bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        #: symbol number -> id: 0 to 255 for a byte, 256 to 511 for a byte that ends its word
        self.symbol = [vocab[c] for c in letters] + [vocab[c + WORD_END] for c in letters]
        self.joined = [bytearray(512) for _ in range(256)]  # [byte][symbol]: do they meet inside a token?
        for t in vocab:
            final = t.endswith(WORD_END) and len(t) > len(WORD_END)
            bytes_ = [byte_of[c] for c in (t.removesuffix(WORD_END) if final else t)]
            if final:
                bytes_[-1] += 256
            for a, b in zip(bytes_, bytes_[1:]):
                self.joined[a][b] = 1
        self.merge = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a], vocab[b]] = rank << 20 | vocab[a + b]  # smallest first, the new id below
        self.width = "H" if max(self.token) < 1 << 16 else "I"  # of an id in the tables
        self.forget()

    def forget(self) -> None:
        """Empties the memo tables."""
        self.fragments, self.older_fragments = {}, {}  # what was met lately, and before that
        self.chunks, self.older_chunks = {}, {}

    def cuts(self, symbols: list[int]) -> list[list[int]]:
        """The symbols of a word, cut wherever two never meet inside a token."""
        joined = self.joined
        at = [i for i, (a, b) in enumerate(zip(symbols, symbols[1:]), 1) if not joined[a][b]]
        if not at:
            return [symbols]
        return [symbols[a:b] for a, b in zip([0, *at], [*at, len(symbols)])]

    def merged(self, fragment: list[int]) -> list[int]:
        """Ids of one fragment: the earliest-ranked pair joins first, leftmost first."""
        ids = [self.symbol[s] for s in fragment]
        if len(ids) > 64:
            return self._merged_long(ids)
        get = self.merge.get
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [best & 0xFFFFF]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for fragments of any length."""
        n, get = len(ids), self.merge.get
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(m, i, p) for i, p in enumerate(zip(ids, ids[1:])) if (m := get(p))]
        heapq.heapify(heap)
        while heap:
            best, i, pair = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], right[i] = best & 0xFFFFF, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (m := get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m, a, (ids[a], ids[b])))
        return [x for x, live in zip(ids, alive) if live]

    def packed(self, ids: list[int]) -> bytes:
        return array(self.width, ids).tobytes()

    def fragment(self, symbols: list[int]) -> bytes:
        """As ``merged``, packed and remembered: fragments of cut words recur."""
        if len(symbols) > LONG_KEY:
            return self.packed(self.merged(symbols))
        key = tuple(symbols)
        found = self.fragments.get(key)
        if found is None:
            found = self.older_fragments.get(key) or self.packed(self.merged(symbols))
            if len(self.fragments) >= FRAGMENTS:
                self.fragments, self.older_fragments = {}, self.fragments
            self.fragments[key] = found
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of a run of text without white space, packed."""
        found = self.chunks.get(text) or self.older_chunks.get(text)
        if found is None:
            found = b""
            for word in [text] if text.isascii() and text.isalpha() else self.word.findall(text):
                symbols = list(word.encode("utf-8", "replace"))
                symbols[-1] += 256
                parts = self.cuts(symbols)
                if len(parts) == 1:
                    found += self.packed(self.merged(symbols))
                else:
                    found += b"".join(map(self.fragment, parts))
            if len(text) > LONG_KEY:
                return found
        if len(self.chunks) >= CHUNKS:
            self.chunks, self.older_chunks = {}, self.chunks
        self.chunks[text] = found
        return found

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens, packed."""
        if not text.isascii():
            # letter by letter: a sigma keeps its form at the end of a word
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        get, chunk = self.chunks.get, self.chunk
        parts = text.split() if not ODD_SEPARATORS.search(text) else filter(None, re.split(f"[{WHITE}]+", text))
        return b"".join([get(p) or chunk(p) for p in parts])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if "<" not in text or not self.special_at.search(text):
            return array(self.width, self.plain(text)).tolist()
        out, end = array(self.width), 0
        for m in self.special_at.finditer(text):
            out.frombytes(self.plain(text[end:m.start()]))
            out.append(self.special[m[0]])
            end = m.end()
        out.frombytes(self.plain(text[end:]))
        return out.tolist()

    def decode(self, ids: Iterable[int] | None) -> str:
        """Tokens joined by a space, special ones included; unknown ids are left out."""
        return " ".join([t for i in ids if (t := self.token.get(i)) is not None]) if ids is not None else ""


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


@contextmanager
def in_task(path: str) -> Iterator[WordBPE]:
    """The tokenizer for one task; the worker goes on to other work without its memo tables."""
    t = tokenizer(path)
    try:
        yield t
    finally:
        t.forget()


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array of int)."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with in_task(path) as t:
            for batch in texts:
                yield pd.Series([t.encode(x) for x in batch], dtype=object)

    return in_small_batches(docs).select("doc_id", ids("text").alias("ids"))


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("string")
    def text(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tokenizer(path)
        for batch in ids:
            yield pd.Series([t.decode(x) for x in batch], dtype=object)

    return encoded.select("doc_id", text("ids").alias("text"))


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one
    pass, so that the ids need not leave the task."""
    path = vocabulary or default_vocabulary()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with in_task(path) as t:
            number = {i: str(i) for i in t.token}
            for batch in texts:
                rows = []
                for x in batch:
                    ids = t.encode(x)
                    listed = " ".join(map(number.__getitem__, ids))
                    rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                                 hashlib.sha256(t.decode(ids).encode()).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return in_small_batches(docs).select("doc_id", both("text").alias("r")).select("doc_id", "r.*")
