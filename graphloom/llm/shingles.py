"""Word shingles of whole batches of texts, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import BYTE_VALUES, mix, spans

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        base, back = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        base[0] = back[0] = 1
        _powers, _inverses = np.cumprod(base, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    return _powers, _inverses


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of each text's words). A-Z count as a-z; words are runs of non-space bytes."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    # A text's first byte starts a word if it is solid, even if the text before ends in a word.
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    starts = np.flatnonzero(solid & (begins[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (begins[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    powers, inverses = _tables(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[_LOWER[raw]] * powers[:n], dtype=np.uint64)])
    hashes = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, ascending; a text of fewer words is one shingle, one of no words none."""
    raw, offsets = spans(column)
    words, at = word_hashes(raw, offsets)
    factors = mix(np.arange(101, 101 + k, dtype=np.uint64)) | _U(1)
    total = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * factors[j]
    total = mix(total)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(total[a : b - k + 1]))
        elif b > a:
            short = (words[a:b] * factors[: b - a]).sum(dtype=np.uint64) + _U(b - a)
            out.append(mix(np.array([short], np.uint64) ^ _U(0xA5A5A5A5A5A5A5A5)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
