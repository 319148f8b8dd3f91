"""Words and shingles of a column of texts as arrays of 64-bit hashes.

A word's hash is taken from prefix sums over the bytes of the whole column (a polynomial with a
random table of byte values, then mixed), so there is no Python loop over words. Equal words have
equal hashes in every task; different ones differ but for a chance of about one in 2**64 a pair.
Memory grows with the number of words; long columns are hashed a megabyte at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_CHUNK = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A well-known finalizer that spreads every bit of a 64-bit number over all others."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@lru_cache
def constants(n: int, seed: int = 0) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed only."""
    steps = np.arange(1, n + 1, dtype=_U) + _U(seed << 32)
    return mix(steps * _U(0x9E3779B97F4A7C15)) | _U(1)


_VALUES = constants(256, 1)
_BASE = int(constants(1, 2)[0])
_PLACES = constants(16, 3)  # one for each word of a shingle


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, _U)
    p[0] = 1
    return np.cumprod(p, dtype=_U)


_POWERS: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)]
    return _POWERS[0], _POWERS[1]


#: Bytes of words between ASCII white space, and of words of letters and digits (and all bytes
#: beyond ASCII); A-Z count as a-z in both.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BETWEEN_SPACES = np.ones(256, bool)
BETWEEN_SPACES[[32, *range(9, 14)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """Words of a column: text i has those from first[i] up to first[i + 1]."""

    data: np.ndarray  # bytes of all texts, lower case
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def joined(self, a: int, b: int) -> bytes:
        """Words a to b, b not among them, with one blank between two."""
        return b" ".join([self.data[self.start[i] : self.end[i]].tobytes() for i in range(a, b)])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's place in them; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, inside: np.ndarray) -> Words:
    """``inside`` tells for every byte value (after A-Z are lowered) whether it belongs to a word."""
    raw, at = text_bytes(texts)
    data = LOWER[raw]
    is_word = inside[data]
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False  # a text's first byte follows nothing
    start = np.flatnonzero(is_word & ~before)
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    ends = at[1:][at[1:] > 0] - 1
    after[ends] = False
    end = np.flatnonzero(is_word & ~after) + 1
    hashes = np.empty(len(start), _U)
    w = 0
    while w < len(start):
        s = start[w]
        upto = max(w + 1, int(np.searchsorted(end, s + _CHUNK, "right")))
        e = end[upto - 1]
        power, inverse = _power_tables(max(_CHUNK, int(e - s)) + 1)
        sums = np.zeros(e - s + 1, _U)
        np.cumsum(_VALUES[data[s:e]] * power[: e - s], out=sums[1:])
        hashes[w:upto] = (sums[end[w:upto] - s] - sums[start[w:upto] - s]) * inverse[start[w:upto] - s]
        w = upto
    return Words(data, start, end, mix(hashes), np.searchsorted(start, at, "left"))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every n consecutive words, at the place of the first."""
    m = max(0, len(words) - n + 1)
    total = np.zeros(m, _U)
    for k in range(n):
        total += words[k : k + m] * _PLACES[k]
    return mix(total)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a whole sequence of fewer words than a window has."""
    return mix(np.atleast_1d((words * _PLACES[: len(words)]).sum(dtype=_U) + _U(len(words))))


def shingle_sets(words: Words, n: int, chosen: np.ndarray | None = None) -> list[np.ndarray]:
    """Distinct shingles of each text (or of those chosen), sorted; fewer than n words are one shingle."""
    every = window_hashes(words.hash, n)
    sets = []
    first, last = words.first[:-1], words.first[1:]
    if chosen is not None:
        first, last = first[chosen], last[chosen]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(every[a : b - n + 1]))
        else:
            sets.append(sequence_hash(words.hash[a:b]) if b > a else np.zeros(0, _U))
    return sets
