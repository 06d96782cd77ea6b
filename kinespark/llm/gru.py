"""A gated recurrent word model in numpy with a class-factored softmax.

Ids 0..words-1 are words, ``words`` stands for any other. Classes hold ``span``
consecutive ids; the last class is that of the others, whose words are told
apart by corpus counts outside this module. P(w | h) = P(class | h) P(w | class, h).

Documents, each with its end (id 0), are laid end to end in lanes that step side
by side; the state is set to zero where a document begins.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, SPAN, WINDOW, LANES = 24, 64, 32, 256
#: Windows that training makes of its words at least, with fewer lanes if need be, down to LEAST.
STEPS, LEAST = 48, 8
#: Steps and lanes of a window when no gradient is taken; the state is carried, so scores don't depend on them.
SCORE_WINDOW, SCORE_LANES = 64, 256
HALF = np.float32(0.5)
Params = dict[str, np.ndarray]


def init(counts: np.ndarray, other: float, hidden: int = HIDDEN, span: int = SPAN, seed: int = 1) -> Params:
    """A model that starts as the unigram distribution of ``counts`` (by id) and ``other``.

    The three gates are reset, update and candidate; the last row of ``to_class`` and ``to_word`` is the bias."""
    rng, words = np.random.default_rng(seed), len(counts)
    classes = -(-words // span)
    padded = np.zeros(classes * span)
    padded[:words] = counts + 0.5
    mass = np.append(padded.reshape(classes, span).sum(1), other + 0.5)
    small = lambda *s: (rng.standard_normal(s) * 0.08).astype(np.float32)
    p = {"gates": small(words + 1, 3, hidden), "back": small(3, hidden, hidden), "bias": np.zeros((3, hidden), np.float32),
         "to_class": small(hidden + 1, classes + 1), "to_word": small(classes, hidden + 1, span)}
    p["to_class"][-1] = np.log(mass / mass.sum())
    p["to_word"][:, -1] = np.log(np.maximum(padded, 1e-9)).reshape(classes, span)
    return p


def pack(p: Params) -> bytes:
    return b"".join(p[k].tobytes() for k in sorted(p))


def unpack(data: bytes, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = np.frombuffer(data, np.float32, n, at).reshape(like[k].shape).copy()
        at += 4 * n
    return out


def _tables(p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of the gates by id, and their weights of the state. A sigmoid is a tanh of half the sum, so those are halved."""
    half = np.array([0.5, 0.5, 1], np.float32)[:, None, None]
    return (p["gates"] + p["bias"]).transpose(1, 0, 2) * half, p["back"] * half


def _steps(tables: tuple[np.ndarray, np.ndarray], x: np.ndarray, h: np.ndarray, keep: bool):
    """Hidden states of a window after each step, and with ``keep`` what their gradient needs; x is (time, lanes).

    An id 0 read is the end of the document before, so the state goes back to zero there."""
    (table, back), time, (lanes, n) = tables, len(x), h.shape
    g = np.empty((3, time, lanes, n), np.float32)
    for k in range(3):
        table[k].take(x.ravel(), 0, out=g[k].reshape(-1, n), mode="clip")
    live = (x != 0).astype(np.float32)[:, :, None]
    states, b = np.empty((time, lanes, n), np.float32), np.empty((3, lanes, n), np.float32)
    before, inner = np.empty((2, time if keep else 1, lanes, n), np.float32)
    for t in range(time):
        last = before[t if keep else 0]
        np.multiply(h, live[t], out=last)
        np.matmul(last, back, out=b)
        if keep:
            inner[t] = b[2]
        rz, c, h = g[:2, t], g[2, t], states[t]
        rz += b[:2]
        np.tanh(rz, out=rz)
        rz *= HALF
        rz += HALF
        b[2] *= rz[0]
        c += b[2]
        np.tanh(c, out=c)
        np.subtract(last, c, out=h)
        h *= rz[1]
        h += c
    return states, (before, inner, g, live)


def _softmax(logits, rows: np.ndarray, columns: np.ndarray):
    """exp of the logits, up to a factor, its sums and the log of the share of (rows, columns)."""
    a = logits()
    a -= a.max()  # one shift for all rows, unless a row is too far below it
    for _ in range(2):
        picked = a[rows, columns].astype(np.float64)
        np.exp(a, out=a)
        total = a @ np.ones(a.shape[1], np.float32)
        if total.min() > 1e-25:
            break
        a = logits()
        a -= a.max(1, keepdims=True)
    return a, total, picked - np.log(total)


def _log_probs(p: Params, hs: np.ndarray, y: np.ndarray, grads: Params | None):
    """Natural log P(y | h) of rows; with ``grads`` also the gradient of -sum for h, and those of the weights in ``grads``."""
    n, span = hs.shape[1], p["to_word"].shape[2]
    last = len(p["to_word"])
    words = len(p["gates"]) - 1
    cls = np.where(y == words, last, y // span).astype(np.int16)
    order = np.argsort(cls, kind="stable")  # rows of a class side by side; those of "other" last, which are told apart elsewhere
    cls, y, rows = cls[order], y[order], np.arange(len(y))
    hs1 = np.empty((len(hs), n + 1), np.float32)
    hs1[:, :n], hs1[:, n] = hs.take(order, 0), 1
    e, total, found = _softmax(lambda: hs1 @ p["to_class"], rows, cls)
    cuts = np.searchsorted(cls, np.arange(last + 1))
    own, parts = cuts[last], [(c, slice(cuts[c], cuts[c + 1])) for c in range(last) if cuts[c] < cuts[c + 1]]

    def logits():
        a = np.empty((own, span), np.float32)
        for c, i in parts:
            np.matmul(hs1[i], p["to_word"][c], out=a[i])
        return a

    if own:
        w = y[:own] - cls[:own].astype(np.int64) * span
        f, sums, more = _softmax(logits, rows[:own], w)
        found[:own] += more
    out = np.empty(len(y))
    out[order] = found
    if grads is None:
        return out, None
    e *= (1 / total)[:, None]
    e[rows, cls] -= 1
    grads["to_class"], grads["to_word"] = hs1.T @ e, np.zeros_like(p["to_word"])
    d = e @ p["to_class"][:n].T
    if own:
        f *= (1 / sums)[:, None]
        f[rows[:own], w] -= 1
        dc = np.empty((own, n), np.float32)
        for c, i in parts:
            np.matmul(f[i], p["to_word"][c, :n].T, out=dc[i])
            np.matmul(hs1[i].T, f[i], out=grads["to_word"][c])
        d[:own] += dc
    at = np.empty(len(y), np.int64)
    at[order] = rows
    return out, d.take(at, 0)


def _sums(rows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in use, the commonest first, and the sums of ``rows`` (gate, place, unit) over the places of each."""
    order = np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")
    at = np.flatnonzero(np.diff(ids[order], prepend=-1))
    n = np.diff(at, append=len(ids))
    turn = np.argsort(-n, kind="stable")
    at, n = at[turn], n[turn]
    flat = rows.transpose(1, 0, 2).reshape(len(ids), -1).take(order, 0)
    out, many = flat.take(at, 0), int((n > 16).sum())
    for j in range(many):
        out[j] = np.ones(n[j], np.float32) @ flat[at[j]:at[j] + n[j]]
    for j in range(1, 16):  # the second place of each of the others, the third, ...
        more = max(many, int((n > j).sum()))
        out[many:more] += flat.take(at[many:more] + j, 0)
    return ids[order[at]], out.reshape(len(at), len(rows), -1)


class Trainer:
    """Adagrad on windows; gradients stop at a window's start, the state doesn't."""

    def __init__(self, p: Params, rate: float = 0.12, start: float = 1e-6):
        self.p, self.rate, self.tokens = p, rate, 0
        self.square = {k: np.full_like(v, start) for k, v in p.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray):
        """Gradients of -sum of a window's log-likelihood (those of ``gates`` by the ids in use), and its last state."""
        p, n, time = self.p, h.shape[1], len(x)
        states, (before, inner, g, live) = _steps(_tables(p), x, h, True)
        grads: Params = {}
        _, d = _log_probs(p, states.reshape(-1, n), y.ravel(), grads)
        d = d.reshape(states.shape)
        r, z, c = g
        k = np.empty_like(g)  # dh to the sums within the three gates; of the candidate, to what the state adds to it
        into = c * c
        np.subtract(1, into, out=into)
        into *= 1 - z
        np.multiply(into, r, out=k[2])
        np.multiply(k[2], inner, out=k[0])
        k[0] *= 1 - r
        np.subtract(before, c, out=k[1])
        k[1] *= z * (1 - z)
        z *= live
        back = np.ascontiguousarray(p["back"].transpose(0, 2, 1))
        dh, db = np.zeros_like(h), np.empty((3, *h.shape), np.float32)
        for t in range(time - 1, -1, -1):
            dh += d[t]
            d[t] = dh
            k[:, t] *= dh
            np.matmul(k[:, t], back, out=db)
            dh *= z[t]
            db[0] += db[1]
            db[0] += db[2]
            db[0] *= live[t]
            dh += db[0]
        d *= into
        grads["back"] = before.reshape(-1, n).T @ k.reshape(3, -1, n)
        k[2] = d
        used, grads["gates"] = _sums(k.reshape(3, -1, n), x.ravel())
        grads["bias"] = grads["gates"].sum(0)
        return grads, used, states[-1]

    def window(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, full: int = 1) -> np.ndarray:
        """One step; a window of less than ``full`` words moves the model less. Returns its last state."""
        grads, used, h = self.gradients(x, y, h)
        scale = np.float32(1 / max(y.size, full))
        for k, v in grads.items():
            p, square = self.p[k], self.square[k]
            v *= scale
            sums = v * v
            at = used if k == "gates" else ...
            sums += square[at]
            square[at] = sums
            np.sqrt(sums, out=sums)
            v *= self.rate
            v /= sums
            p[at] -= v
        self.tokens += y.size
        return h


def windows(flat: np.ndarray, at: np.ndarray, size: np.ndarray, window: int):
    """(x, y, place, live) of lanes, the longest first: lane j has ``size[j]`` ids of ``flat`` from ``at[j]`` on.

    Lanes that are over are left out; one that ends within a window repeats its last id, which isn't ``live``."""
    for done in range(0, int(size[0]) if len(size) else 0, window):
        n = int((size > done).sum())
        step = done + np.arange(min(window, int(size[0]) - done))[:, None]
        place = at[:n] + np.minimum(step, size[:n] - 1)
        yield flat[place - 1], flat[place], place, step < size[:n]  # the id before the first is the last one: an end


def train(trainer: Trainer, docs: list[np.ndarray]) -> None:
    """One pass over all documents, end to end in lanes of one length and a short one for what is left."""
    if not docs:
        return
    flat, hidden = np.concatenate(docs), trainer.p["back"].shape[1]
    lanes = int(np.clip(len(flat) // (WINDOW * STEPS), LEAST, LANES))
    each = len(flat) // lanes
    for at, size in ((np.arange(lanes) * each, np.full(lanes, each)), (np.array([lanes * each]), np.array([len(flat) - lanes * each]))):
        h = np.zeros((len(at), hidden), np.float32)
        for x, y, _, _ in windows(flat, at, size, WINDOW):
            h = trainer.window(x, y, h, lanes * WINDOW)


def _lanes(size: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents of each lane, the longest lane first: each document goes, the longest first, to the shortest lane so far."""
    heap = [(0, j) for j in range(min(lanes, len(size)))]
    held: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-size, kind="stable").tolist():
        n, j = heap[0]
        held[j].append(i)
        heapq.heapreplace(heap, (n + int(size[i]), j))
    return [held[j] for _, j in sorted(heap, reverse=True)]


def score(p: Params, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole document, its state carried across windows."""
    out, hidden = np.zeros(len(docs)), p["back"].shape[1]
    if not docs:
        return out
    size = np.array([len(d) for d in docs])
    held = _lanes(size, SCORE_LANES)
    order = np.concatenate(held)
    flat, lane = np.concatenate([docs[i] for i in order]), np.array([size[d].sum() for d in held])
    logs, h = np.empty(len(flat)), np.zeros((len(lane), hidden), np.float32)
    tables = _tables(p)
    for x, y, place, live in windows(flat, np.cumsum(lane) - lane, lane, SCORE_WINDOW):
        states, _ = _steps(tables, x, h[:x.shape[1]], False)
        found, _ = _log_probs(p, states.reshape(-1, hidden), y.ravel(), None)
        logs[place[live]] = found.reshape(y.shape)[live]
        h = states[-1]
    out[order] = np.add.reduceat(logs, np.cumsum(size[order]) - size[order])
    return out
