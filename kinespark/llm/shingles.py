"""Word and shingle digests of texts, a batch at a time, in numpy.

Words are runs of anything but ASCII white space, A-Z lower-cased. A word's digest
is a polynomial over random values of its bytes, modulo 2**64, so that one
running sum over the batch gives all of them.
"""

from __future__ import annotations

import numpy as np

K = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20_240_601)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLAIN = np.where(_SPACE, np.uint64(0), _VALUE)
_VALUE[65:91] = _VALUE[97:123]  # capitals fold
_VALUE[_SPACE] = 0
_COEF = _RNG.integers(1, 1 << 63, K, dtype=np.uint64) | np.uint64(1)
#: Bytes of text handled at once.
STEP = 1 << 20
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP + (STEP >> 2))
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(texts: list[str], step: int = STEP):
    """Runs of texts of about ``step`` characters; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > step:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def words(texts: list[str], fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of all words, their bytes, and where each text's words begin (one more than texts);
    without ``fold`` capitals count as letters of their own."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    a = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    up, down = _power(len(a))
    total = np.cumsum((_VALUE if fold else _PLAIN)[a] * up)
    space = _SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    digest = mix((total[end - 1] - total[start - 1]) * down[start])
    first = np.cumsum([1] + [len(r) + 1 for r in raw])
    return digest, end - start, np.searchsorted(start, first)


def shingle_at(digest: np.ndarray, bounds: np.ndarray, k: int = K) -> np.ndarray:
    """Digest of the k words from each place on; only places k or more before their text's end count."""
    n = len(digest)
    out = np.zeros(n, np.uint64)
    if n >= k:
        m = n - k + 1
        s = digest[:m] * _COEF[0]
        for i in range(1, k):
            s = s + digest[i:m + i] * _COEF[i]
        out[:m] = mix(s)
    for d in np.flatnonzero((np.diff(bounds) < k) & (np.diff(bounds) > 0)):  # a short text is one shingle
        i, j = bounds[d], bounds[d + 1]
        out[i] = mix(np.array([(digest[i:j] * _COEF[:j - i]).sum() + np.uint64(j - i)], np.uint64))[0]
    return out


def places(bounds: np.ndarray, k: int = K) -> np.ndarray:
    """How many shingles, counted with repeats, each text has."""
    n = np.diff(bounds)
    return np.where(n >= k, n - k + 1, np.minimum(n, 1))


def sets(texts: list[str], k: int = K) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    out = []
    for run in batches(texts):
        digest, _, bounds = words(run)
        s, n = shingle_at(digest, bounds, k), places(bounds, k)
        out += [np.unique(s[b:b + c]) for b, c in zip(bounds, n)]
    return out
