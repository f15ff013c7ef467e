"""Words of many texts at once: byte classes, boundaries and 64-bit word hashes in numpy.

Texts are handled as UTF-8 bytes. Both word classes of this package contain every byte of a
non-ASCII character, so a run of such bytes is a run of such characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E6C63D0676A9A99
_PINV = pow(_P, -1, 1 << 64)
_POW: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, *range(9, 14)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POW[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """doc: index of each word's text; start, end: bytes within ``raw``; hash: of the lower-cased bytes."""

    __slots__ = ("doc", "end", "hash", "n_docs", "off", "raw", "start")

    def __init__(self, texts: pa.LargeStringArray, is_word: np.ndarray, hashes: bool = True):
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.n_docs = n
        low = LOWER[self.raw]
        mask = is_word[low]
        m = len(mask)
        first = np.zeros(m + 1, bool)
        first[self.off] = True
        before = np.empty(m, bool)
        after = np.empty(m, bool)
        if m:
            before[0] = after[-1] = False
            before[1:] = mask[:-1]
            after[:-1] = mask[1:]
            before &= ~first[:-1]
            after &= ~first[1:]
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.doc = np.searchsorted(self.off, self.start, side="right") - 1
        self.hash = None
        if hashes:
            total = np.zeros(m + 1, np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_P, m), out=total[1:])
            h = (total[self.end] - total[self.start]) * _powers(_PINV, m + 1)[self.start]
            self.hash = mix(h ^ (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def hash_words(words: list[str]) -> np.ndarray:
    """The hashes that :class:`Words` gives to whole strings, each taken as one word."""
    out = Words(pa.array([f"{w}" for w in words], pa.large_string()), np.ones(256, bool))
    return out.hash
