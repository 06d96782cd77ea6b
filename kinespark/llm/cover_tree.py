"""Cover tree over one block of vectors, for largest inner products.

Vectors get one more component that brings all to the norm of the longest
(queries get 0), so that the largest inner product is the nearest point. A node is a
centre and the radius that covers all points below it; its children's centres lie
further apart than their level's radius, a fixed share of their parent's. From the
distance to the centre and the radius follow bounds of every inner product below
the node.
"""

from __future__ import annotations

import pickle

import numpy as np

LEAF, SHRINK = 32, 0.7
#: Ranks within a block: a key is ``score << RANK_BITS`` plus the points after it.
RANK_BITS = 13
BLOCK = 1 << RANK_BITS
NONE, FULL = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Scores stay below this, so that keys fit; sums of products are exact in doubles.
LIMIT = 1 << 49
#: Points of a leaf compared at once.
SLICE = 512


class CoverTree:
    """``vectors`` (n, d) of whole numbers, ``ids`` ascending, ``labels``; at most BLOCK points."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors.astype(np.float64)
        vectors = self.vectors
        norms = (vectors * vectors).sum(axis=1)
        self.top = int(norms.max())  # the common squared norm
        points = np.column_stack([vectors, np.sqrt(np.maximum(self.top - norms, 0))])
        level = [(np.arange(len(ids)), 0, self._radius(points, np.arange(len(ids)), 0), -1)]
        self.levels, self.leaves = [], []  # a level: centres, radii, parents, least point, leaf number or -1
        while level:
            below, leaf = [], np.full(len(level), -1)
            for k, (members, centre, radius, _) in enumerate(level):
                if len(members) <= LEAF or radius < 1e-6:
                    leaf[k] = len(self.leaves)
                    self.leaves.append(members)
                else:
                    below += [(*child, k) for child in self._children(points, members, centre, radius)]
            self.levels.append((np.array([x[1] for x in level]), np.array([x[2] for x in level]), np.array([x[3] for x in level]),
                                np.array([x[0].min() for x in level]), leaf))
            level = below

    @staticmethod
    def _away(points: np.ndarray, members: np.ndarray, centre: int) -> np.ndarray:
        d = points[members] - points[centre]
        return np.sqrt((d * d).sum(axis=1))

    def _radius(self, points: np.ndarray, members: np.ndarray, centre: int) -> float:
        return float(self._away(points, members, centre).max())

    def _children(self, points: np.ndarray, members: np.ndarray, centre: int, radius: float):
        """Greedy cover with the level's radius; a child's own radius is that of its points.

        The parent's centre comes first; the next centre is the point furthest from all
        centres so far, and each point goes to its nearest centre."""
        reach, own = SHRINK * radius, np.zeros(len(members), np.int64)
        centres, near = [centre], self._away(points, members, centre)
        while near.max() > reach:
            far = int(members[near.argmax()])
            d = self._away(points, members, far)
            closer = d < near
            own[closer], near[closer] = len(centres), d[closer]
            centres.append(far)
        for c, centre in enumerate(centres):
            mine = own == c
            if mine.any():
                yield members[mine], centre, float(near[mine].max())

    def dump(self) -> bytes:
        """The tree as bytes, whole components in four or eight bytes each."""
        small = np.abs(self.vectors).max(initial=0) < 1 << 31
        return pickle.dumps((self.ids, self.labels, self.vectors.astype(np.int32 if small else np.int64), self.top, self.levels, self.leaves))

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree.ids, tree.labels, vectors, tree.top, tree.levels, tree.leaves = pickle.loads(data)
        tree.vectors = vectors.astype(np.float64)
        return tree

    def search(self, queries: np.ndarray, want: np.ndarray, same: bool, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
        """Keys (query, window, k) of the k best points in each window, best first, NONE where there are fewer.

        A point counts for a query if its label equals ``want`` (``same``) or differs from it,
        its id isn't the query's ``own`` and its score lies within [low, high] of the
        window. Nodes outside all windows are skipped level by level; leaves are then opened
        from the best bound on, until no bound can better any window's last place."""
        n, m = low.shape
        best = np.full((n, m, k), NONE, np.int64)
        lowest, highest = low.min(axis=1), high.max(axis=1)
        q = queries.astype(np.float64)
        norms = (q * q).sum(axis=1)
        if float(self.top) * norms.max() >= float(LIMIT) ** 2:
            raise ValueError("inner products of 2**49 and more aren't exact")
        best[low > high] = FULL  # an empty window wants nothing
        bound = np.full((n, len(self.leaves)), -np.inf)
        floor = np.full((n, len(self.leaves)), np.inf)
        first = np.zeros(len(self.leaves), np.int64)
        alive = np.ones((n, 1), bool)
        for centres, radii, parents, least, leaf in self.levels:
            open_ = alive[:, np.maximum(parents, 0)] if parents[0] >= 0 else alive
            dot = q @ self.vectors[centres].T
            away = np.sqrt(np.maximum(norms[:, None] + self.top - 2 * dot, 0))
            spare = 1e-6 * (1 + self.top + norms[:, None])  # room for rounding
            upper = (norms[:, None] + self.top - np.maximum(away - radii, 0) ** 2) / 2 + spare
            lower = (norms[:, None] + self.top - (away + radii) ** 2) / 2 - spare
            alive = open_ & (upper >= lowest[:, None]) & (lower <= highest[:, None])
            ends = np.flatnonzero(leaf >= 0)
            bound[:, leaf[ends]] = np.where(alive[:, ends], upper[:, ends], -np.inf)
            floor[:, leaf[ends]] = lower[:, ends]
            first[leaf[ends]] = least[ends]
        # a bound as a key: the best score a leaf may hold, at its first point
        cap = np.minimum(np.floor(np.where(bound > -np.inf, np.minimum(bound, LIMIT), 0)).astype(np.int64), highest[:, None])
        keys = np.where(bound > -np.inf, (cap << RANK_BITS) + (BLOCK - 1 - first), NONE)
        order = np.argsort(keys, axis=1)[:, ::-1]
        for turn in range(order.shape[1]):
            leaves = order[:, turn]
            key = keys[np.arange(n), leaves]
            # a window still wants a leaf that may better its last place and reaches into it
            useful = (key[:, None] > best[:, :, -1]) & (bound[np.arange(n), leaves][:, None] >= low) & (floor[np.arange(n), leaves][:, None] <= high)
            going = (key > NONE) & ((key[:, None] > best[:, :, -1]).any(axis=1))
            if not going.any():
                break
            live = np.flatnonzero(going & useful.any(axis=1))
            live = live[np.argsort(leaves[live], kind="stable")]
            cuts = np.flatnonzero(np.diff(leaves[live])) + 1
            for group in np.split(live, cuts) if len(live) else ():
                leaf = self.leaves[leaves[group[0]]]
                for members in (leaf[i:i + SLICE] for i in range(0, len(leaf), SLICE)):
                    score = (q[group] @ self.vectors[members].T).astype(np.int64)
                    fits = ((self.labels[members][None, :] == want[group][:, None]) == same) & (self.ids[members][None, :] != own[group][:, None])
                    key = (score << RANK_BITS) + (BLOCK - 1 - members)[None, :]
                    inside = fits[:, None, :] & (score[:, None, :] >= low[group][:, :, None]) & (score[:, None, :] <= high[group][:, :, None])
                    found = np.concatenate([best[group], np.where(inside, key[:, None, :], NONE)], axis=2)
                    best[group] = np.sort(np.partition(found, -k, axis=2)[:, :, -k:], axis=2)[:, :, ::-1]
        best[low > high] = NONE
        return best

    def read(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of keys."""
        return keys >> RANK_BITS, self.ids[BLOCK - 1 - (keys & (BLOCK - 1))]
