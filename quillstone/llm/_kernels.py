"""NumPy kernels over many texts at once: words, hashes of words and of runs of words.

Texts are joined with a space between them, so that one pass over the bytes
handles a whole block of documents. A word is ``[^\\x20\\x09-\\x0D]+``.
Hashes are 64-bit polynomial sums modulo 2**64 with a murmur finaliser.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit murmur finaliser, in a new array."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


@lru_cache(4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)

    def run(b: int) -> np.ndarray:
        out = np.full(n, b, U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(base), run(inverse)


def _room(n: int) -> int:
    return 1 << max(20, int(n).bit_length())


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """One hash for each ``values[start:end]``, values being bytes or 64-bit hashes."""
    power, inverse = _powers(_room(len(values)), BASES[which])
    total = np.empty(len(values) + 1, U)
    total[0] = 0
    np.cumsum((values.astype(U) + U(1)) * power[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h += (ends - starts).astype(U) * U(0x165667B19E3779F9)
    return mix(h)


class Words:
    """The words of a block of texts.

    ``buf``: the bytes; ``first``: where each text begins in it; ``start``, ``end``:
    of each word in ``buf``; ``doc``: each word's text; ``count``: words by text.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b" ".join(texts) + b" "
        self.buf = np.frombuffer(joined, np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        sizes = np.fromiter((len(x) for x in texts), np.int64, len(texts))
        self.sizes = sizes
        self.first = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        space = IS_SPACE[self.buf]
        self.space = space
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        low = np.searchsorted(self.start, self.first)
        self.low = low  # the first word of each text
        self.count = np.diff(np.append(low, len(self.start)))
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, which: int = 0) -> np.ndarray:
        return range_hashes(self.buf, self.start, self.end, which)

    def runs(self, k: int, h: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words of the runs of k consecutive words of one text, and the runs' hashes."""
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[k - 1 :] == self.doc[:n])
        return at, range_hashes(h, at, at + k, which)


def by_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of values by text, as integers."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def unique_pairs(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, h), ordered by doc and then h."""
    if not len(h):
        return doc, h
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], h[keep]
