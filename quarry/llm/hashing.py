"""Vectorised word hashes of whole batches of texts.

Texts become one byte array; numpy works on blocks of it, so a word costs
nanoseconds rather than a Python call. A long text is worked through piece by
piece, cut between words, so memory follows its words (eight bytes each), not
the tens of bytes a byte that a block takes. Hashes are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 20  # bytes of text handled at once; a longer text is a group of its own, in pieces
LONG = 4 * BLOCK
SMALL = BLOCK // 4  # for work that holds many numbers a word
K = np.uint64(0x9E3779B97F4A7C15)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
S33, S29 = np.uint64(33), np.uint64(29)

_powers = np.cumprod(np.full(1 << 12, K, np.uint64))


def powers(n: int) -> np.ndarray:
    """K, K**2, ... modulo 2**64."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * _powers[-1]])
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> S33)) * M1
    h = (h ^ (h >> S29)) * M2
    return h ^ (h >> S33)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


#: A-Z to a-z, all other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(texts: Iterable[str | None], least: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as UTF-8 bytes) in groups of about ``least`` bytes."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass") if t else b""
        group.append(data)
        size += len(data)
        if size >= least:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def pieces_of(text: bytes, between: np.ndarray, size: int = BLOCK) -> Iterator[bytes]:
    """A text cut at bytes that stand between words, into pieces of about ``size`` bytes (a longer word is one piece)."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text):
            gap = np.flatnonzero(between[np.frombuffer(text, np.uint8, min(size, len(text) - end), end)])
            if len(gap):
                end += int(gap[0])
                break
            end += size
        yield text[at:end]
        at = end


def words_of(group: list[bytes], between: np.ndarray, fold: np.ndarray | None = None):
    """(hashes of all words of a group, number of words of each text).

    ``between`` tells the bytes that stand between words; texts are kept apart by
    one such byte.
    """
    if sum(map(len, group)) <= LONG:
        return _words_of(group, between, fold)
    parts, counts = [], []
    for text in group:
        own = [_words_of([p], between, fold)[0] for p in pieces_of(text, between)] or [np.zeros(0, np.uint64)]
        parts += own
        counts.append(sum(map(len, own)))
    return np.concatenate(parts), np.array(counts, np.int64)


def _words_of(group: list[bytes], between: np.ndarray, fold: np.ndarray | None):
    gap = bytes([int(np.flatnonzero(between)[0])])
    data = np.frombuffer(gap.join(group) + gap, np.uint8)
    inside = ~between[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(group), np.int64)
    sizes = ends - starts
    kept = data[inside]
    if fold is not None:
        kept = fold[kept]
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(len(kept)) - np.repeat(offsets, sizes)
    values = (kept.astype(np.uint64) + np.uint64(1)) * powers(int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(values, offsets))
    limits = np.cumsum([len(g) + 1 for g in group])
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return hashes, counts
