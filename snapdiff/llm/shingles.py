"""Word hashes and sets of word n-grams, in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240110)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(2 * len(_powers[0]), n, 1 << 14)
        for k, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 text: A-Z lower-cased, cut at ASCII white space only.

    A word's hash is a polynomial over random values of its bytes, from running sums over the text.
    """
    codes = np.frombuffer(raw, np.uint8)
    if not len(codes):
        return np.empty(0, np.uint64)
    up, down = _tables(len(codes) + 1)
    space = _SPACE[codes]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    if not space[-1]:
        edge = np.concatenate([edge, [len(codes)]])
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * up[: len(codes)], out=sums[1:])
    starts, ends = edge[::2], edge[1::2]
    return mixed((sums[ends] - sums[starts]) * down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads differences over all 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word n-grams at each place; none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        total += h[j : j + n] * _PLACE[j % 64]
    return mixed(total)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """``k``-word shingles in order; fewer words, but not none, make one shingle of all words."""
    return ngrams(h, min(k, len(h))) if len(h) else np.empty(0, np.uint64)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingles, sorted."""
    return np.unique(shingles(h, k))
