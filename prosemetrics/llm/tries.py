"""Self-joins of binary tries over 64-bit keys, in numpy: which keys differ in a few bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Node pairs with at most this many key pairs are compared key by key.
LEAF = 8
# Node pairs that are held at once; more are put aside and taken up later.
FRONT = 1 << 19


class Forest:
    """Links among sorted keys, kept as one label for each linked set of them.

    A node of a trie is a range of the sorted keys that share their first bits.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.labels = np.arange(len(keys))
        self._ones: dict[int, np.ndarray] = {}
        self._mark()

    def _mark(self) -> None:
        self.breaks = np.concatenate([[0], np.cumsum(self.labels[1:] != self.labels[:-1])]) if len(self.keys) else self.labels

    def _split(self, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        """Where the keys with a one at ``depth`` begin in each range."""
        if depth not in self._ones:
            bit = (self.keys >> np.uint64(63 - depth)) & np.uint64(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        ones = self._ones[depth]
        return high - (ones[high] - ones[low])

    def _one_set(self, pairs: np.ndarray) -> np.ndarray:
        """Node pairs whose keys are all linked with each other already."""
        a, b, c, d, _ = pairs
        flat = (self.breaks[b - 1] == self.breaks[a]) & (self.breaks[d - 1] == self.breaks[c])
        return flat & (self.labels[a] == self.labels[c])

    def _link(self, left: np.ndarray, right: np.ndarray) -> None:
        labels = self.labels
        while True:
            a, b = labels[left], labels[right]
            open_ = a != b
            if not open_.any():
                break
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
            while True:
                nxt = labels[labels]
                if (nxt == labels).all():
                    break
                labels[:] = nxt
        self._mark()

    def _leaves(self, pairs: np.ndarray, budget: int) -> None:
        """Compare the keys of small node pairs one by one and link the close ones."""
        a, b, c, d, _ = pairs
        width = d - c
        size = (b - a) * width
        owner = np.repeat(np.arange(len(a)), size)
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        left = a[owner] + within // width[owner]
        right = c[owner] + within % width[owner]
        close = np.bitwise_count(self.keys[left] ^ self.keys[right]) <= budget
        if close.any():
            self._link(left[close], right[close])

    def join(self, pairs: np.ndarray, depth: int, budget: int) -> None:
        """Link the keys of node pairs (rows: low, high, low, high, differing bits) that differ in at
        most ``budget`` bits.

        Both nodes of a pair go down together; a pair ends when its bits exceed the budget, when
        its keys are linked already, or in a comparison of its last few keys.
        """
        aside = [(pairs, depth)]
        while aside:
            pairs, depth = aside.pop()
            while pairs.shape[1]:
                if pairs.shape[1] > FRONT:
                    aside += [(pairs[:, i : i + FRONT], depth) for i in range(FRONT, pairs.shape[1], FRONT)]
                    pairs = pairs[:, :FRONT]
                pairs = pairs[:, ~self._one_set(pairs)]
                a, b, c, d, bits = pairs
                small = ((b - a) * (d - c) <= LEAF) | (depth == 64)
                if small.any():
                    self._leaves(pairs[:, small], budget)
                    pairs = pairs[:, ~small]
                    a, b, c, d, bits = pairs
                if not pairs.shape[1]:
                    break
                m, n = self._split(a, b, depth), self._split(c, d, depth)
                twin = a == c
                more = bits + 1
                grown = [
                    np.stack([a, m, c, n, bits]),
                    np.stack([m, b, n, d, bits]),
                    np.stack([a, m, n, d, more]),
                    np.stack([m, b, c, n, more])[:, ~twin],  # a node's halves meet once
                ]
                pairs = np.concatenate(grown, axis=1)
                a, b, c, d, bits = pairs
                pairs = pairs[:, (b > a) & (d > c) & (bits <= budget)]
                depth += 1


def linked(keys: np.ndarray, pairs: np.ndarray, depth: int, budget: int) -> Iterator[tuple[int, int]]:
    """Places of keys and of another key they are linked with, directly or over other keys.

    Small budgets come first.  In a crowd of near-equal keys they link most of it with little work,
    and what is linked need not be compared again.
    """
    forest = Forest(keys)
    for bits in sorted({min(1, budget), budget // 2, budget}):
        forest.join(pairs, depth, bits)
    at = np.flatnonzero(forest.labels != np.arange(len(keys)))
    return zip(at.tolist(), forest.labels[at].tolist())
