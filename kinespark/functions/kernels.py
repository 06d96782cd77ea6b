"""Recursive filters on blocks of series in NumPy, as sums of one-pole recursions.

w <- p w + x runs over all samples at once: after k doublings each place holds the
recursion over its last 2**k samples. Poles inside the unit circle forget, so the
doublings stop once p**(2**k) is below TINY.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

TINY = 1e-19


@dataclass(frozen=True)
class Poles:
    """y = direct x + Re sum(weights w), w <- pole w + x. One pole stands for a conjugate
    pair, with twice the residue as its weight; a real pole stands for itself."""

    poles: np.ndarray
    weights: np.ndarray
    direct: float = 0.0

    def every(self, state: np.ndarray) -> Iterator[tuple[complex, complex, np.ndarray]]:
        """Each single pole, its residue and its share of ``state`` (.., poles, channels)."""
        for i, (p, r) in enumerate(zip(self.poles, self.weights)):
            s = state[..., i, :]
            if p.imag:
                yield p, r / 2, s
                yield p.conjugate(), r.conjugate() / 2, s.conj()
            else:
                yield p, r, s


def smoothing_alpha(fs: float, cutoff: float) -> float:
    """Coefficient of the first-order low-pass."""
    dt, rc = 1.0 / fs, 1.0 / (2.0 * math.pi * cutoff)
    return dt / (rc + dt)


@lru_cache(maxsize=4096)
def exponential(alpha: float) -> Poles:
    """y <- (1 - alpha) y + alpha x."""
    return Poles(np.array([1.0 - alpha], complex), np.array([alpha], complex))


def first_order(fs: float, cutoff: float) -> Poles:
    return exponential(smoothing_alpha(fs, cutoff))


def _gaps(order: int, wn: float) -> np.ndarray:
    """1 - pole of each digital pole of a low-pass at ``wn`` of the Nyquist rate (bilinear
    transform, pre-warped); kept apart from the poles so that low cutoffs lose no digits."""
    k = math.tan(math.pi * wn / 2.0)
    angles = math.pi * (2 * np.arange(order) + order + 1) / (2 * order)
    analog = k * np.exp(1j * angles)
    return -2 * analog / (1 - analog)


def butterworth_poles(order: int, wn: float) -> tuple[np.ndarray, float]:
    """Poles and gain; all zeros lie at -1."""
    gaps = _gaps(order, wn)
    return 1 - gaps, float(np.real(np.prod(gaps))) / 2.0**order


@lru_cache(maxsize=4096)
def butterworth(order: int, wn: float) -> Poles:
    """gain (1 + 1/z)^order / prod(1 - p/z) in partial fractions."""
    gaps, (poles, gain) = _gaps(order, wn), butterworth_poles(order, wn)
    residues = np.array([gain * (1 + 1 / p) ** order / np.prod((np.delete(gaps, i) - gaps[i]) / p) for i, p in enumerate(poles)])
    upper, real = poles.imag > 1e-15, np.abs(poles.imag) <= 1e-15
    return Poles(np.concatenate([poles[upper], poles[real].real]), np.concatenate([2 * residues[upper], residues[real]]), float(np.real(gain / np.prod(-poles))))


def lowpass(fs: float, cutoff: float, order: int = 4) -> Poles:
    return butterworth(order, min(0.9999, cutoff / (fs * 0.5)))


def _recursion(x: np.ndarray, pos: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """w (n, poles, channels) of samples ``x`` (same shape); ``pos`` counts the samples of a series, ``poles`` are (n, poles)."""
    w, step, q = x, 1, poles
    longest, slowest = int(pos.max(initial=0)) + 1, float(np.abs(poles).max(initial=0))
    while step < longest and slowest**step > TINY:
        add = q[step:, :, None] * w[:-step]
        add[pos[step:] < step] = 0
        w[step:] += add
        q, step = q * q, step * 2
    return w


def run_poles(
    parts: Sequence[np.ndarray], filters: Sequence[Poles], begins: np.ndarray, ends: np.ndarray, both_ways: bool
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Filter series parts (samples, channels) at once: results, and the states each part
    leaves behind it and, ``both_ways``, before it (parts, poles, channels).

    A part that begins or ends its series takes its outer sample as constant beyond;
    other parts start from state zero."""
    length = np.array([len(p) for p in parts])
    first = np.cumsum(length) - length
    last = first + length - 1
    owner = np.repeat(np.arange(len(parts)), length)
    pos = np.arange(len(owner)) - first[owner]
    poles, weights = np.stack([f.poles for f in filters]), np.stack([f.weights for f in filters])
    direct = np.array([f.direct for f in filters])[owner][:, None]

    def one_way(x: np.ndarray, edge: np.ndarray, known: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.repeat(x[:, None, :].astype(complex), poles.shape[1], axis=1)
        before = np.where(known[:, None, None], x[edge][:, None, :] / (1 - poles)[:, :, None], 0)
        w[edge] += poles[:, :, None] * before
        w = _recursion(w, at, poles[own])
        return np.real((weights[own][:, :, None] * w).sum(axis=1)), w

    x = np.concatenate(parts)
    y, w = one_way(x, first, begins, owner, pos)
    y += direct * x
    ahead = w[last]
    back = np.zeros_like(ahead)
    if both_ways:
        n = len(x) - 1
        z, v = one_way(y[::-1], n - last, ends, owner[::-1], (length[owner] - 1 - pos)[::-1])
        back = v[n - first]
        y = z[::-1] + direct * y
    return np.split(y, first[1:]), ahead, back


def odd_extension(x: np.ndarray, n: int, front: bool, back: bool) -> np.ndarray:
    """Point reflection of ``n`` samples about the ends."""
    parts = [2 * x[0] - x[n:0:-1]] if front else []
    parts.append(x)
    if back:
        parts.append(2 * x[-1] - x[-2 : -n - 2 : -1])
    return np.concatenate(parts)


def filled(
    i: np.ndarray, starts: np.ndarray, value: tuple[np.ndarray, np.ndarray], before: Sequence[tuple[np.ndarray, np.ndarray]], behind: Sequence[tuple[np.ndarray, np.ndarray]],
) -> np.ndarray:
    """Values of series that lie end to end (first rows ``starts``, index ``i``), gaps filled: linear
    inside, end values outside. A column is (values, known); ``before`` and ``behind`` are the columns
    (index, value) of the nearest known rows beyond the given ones."""
    x, known = value
    rows = np.arange(len(x))
    size = np.diff(np.append(starts, len(x)))
    first = np.repeat(starts, size)
    gaps = np.flatnonzero(~known)

    def near(at: np.ndarray, here: np.ndarray, beyond: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        at, here = np.where(here, at, 0)[gaps], here[gaps]
        (t, there), (v, _) = beyond
        return np.where(here, i[at], t[gaps]), np.where(here, x[at], v[gaps]), here | there[gaps]

    prev = np.maximum.accumulate(np.where(known, rows, -1))
    nxt = np.minimum.accumulate(np.where(known, rows, len(x))[::-1])[::-1]
    t0, v0, has0 = near(prev, prev >= first, before)
    t1, v1, has1 = near(nxt, nxt < first + np.repeat(size, size), behind)
    both = has0 & has1
    share = (i[gaps] - t0) / np.where(both, t1 - t0, 1)
    full = x.copy()
    full[gaps] = np.where(both, v0 + (v1 - v0) * share, np.where(has0, v0, v1))
    return full


def window_mean(i: np.ndarray, n: np.ndarray, starts: np.ndarray, x: np.ndarray, half: int) -> np.ndarray:
    """Mean of each row and the ``half`` on both sides, added up in their order. Series lie end to end;
    those of ``n`` rows are mirrored at both ends. Rows whose window isn't given whole get no meaning."""
    top = n - 1
    origin = np.repeat(starts - i[starts], np.diff(np.append(starts, len(x))))  # place of index 0
    edge = np.flatnonzero((i < half) | (i > top - half))
    period = np.maximum(2 * top[edge], 1)
    total, ends, wide = np.zeros(len(x)), np.zeros(len(edge)), np.pad(x, half)
    for k in range(-half, half + 1):
        total += wide[half + k: half + k + len(x)]
        p = (i[edge] + k) % period
        ends += x[np.clip(origin[edge] + np.where(top[edge] > 0, np.minimum(p, period - p), 0), 0, len(x) - 1)]
    total[edge] = ends
    return total / (2 * half + 1)
