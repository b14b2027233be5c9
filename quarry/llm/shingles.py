"""Sets of hashed word shingles of whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from quarry.llm import hashing

WORDS = 5
STEP = 1 << 20  # shingles hashed at once
BETWEEN = hashing.byte_set((0x09, 0x0D), (0x20, 0x20))
_C = np.random.default_rng(11).integers(1, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _C[WORDS:] * np.arange(256, dtype=np.uint64)  # for a sequence of n words


def shingle_sets(texts: Iterable[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (whole sequence if shorter), of at most ``WORDS`` words."""
    for _, group in hashing.blocks(texts, hashing.SMALL):
        h, counts = hashing.words_of(group, BETWEEN, hashing.LOWER)
        full = np.full(max(0, len(h) - words + 1), _SALT[words], np.uint64)
        for at in range(0, len(full), STEP):
            part = full[at:at + STEP]
            for j in range(words):
                part += h[at + j:at + j + len(part)] * _C[j]
            part[:] = hashing.mix(part)
        start = 0
        for n in counts.tolist():
            if n >= words:
                own = full[start:start + n - words + 1]
                own.sort()  # in place: these shingles are read once
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif n:
                yield hashing.mix((h[start:start + n] * _C[:n]).sum(keepdims=True) + _SALT[n])
            else:
                yield np.zeros(0, np.uint64)
            start += n
