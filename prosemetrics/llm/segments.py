"""Bounds on inner products from the means and deviations of vector segments, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Segments of a vector at the levels of the hierarchy, coarse to fine.
LEVELS = (1, 4, 16)
# Sums of products below this are exact as doubles.
DOUBLE_EXACT = 2.0**53
# Bounds are widened by this share of the largest product that their terms can have.
SLACK = 1e-9
# Pairs that are scored one by one at once, and the share of pairs from which all are, as one product.
PAIRS, DENSE = 1 << 16, 0.2


class Summaries:
    """Vectors (rows of whole numbers) with the mean and deviation of their segments at each level.

    A segment with values x has the mean m and the deviation d = |x - m|.  For segments x and y of
    n values, their product is n m m' + (x - m)(y - m'), and the last term lies between -d d' and d d'.
    """

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        dims = vectors.shape[1]
        self.levels = []
        for count in LEVELS:
            edges = np.unique([dims * i // count for i in range(count + 1)])
            if len(edges) < 2:
                edges = np.array([0, dims])
            lengths = np.maximum(np.diff(edges), 1)
            parts = [vectors[:, a:b] for a, b in zip(edges, edges[1:])]
            means = np.stack([p.sum(axis=1) for p in parts], axis=1) / lengths
            deviations = np.stack([np.sqrt(((p - m[:, None]) ** 2).sum(axis=1)) for p, m in zip(parts, means.T)], axis=1)
            self.levels.append((means * np.sqrt(lengths), deviations))
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def bounds(a: Summaries, b: Summaries, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores of ``a`` with the rows ``places`` of ``b``, by one level."""
    (ma, da), (mb, db) = a.levels[level], b.levels[level]
    middle = ma @ mb[places].T
    reach = da @ db[places].T + SLACK * np.outer(a.norms, b.norms[places])
    return middle - reach, middle + reach


def exact(a: Summaries, b: Summaries, places: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """The scores of ``a`` with the rows ``places`` of ``b`` where they are ``needed`` (elsewhere of no
    meaning); of any size, as long as they fit 64 bits."""
    largest = a.norms.max(initial=0) * b.norms[places].max(initial=0)
    if needed.mean() >= DENSE and largest < DOUBLE_EXACT / 2:
        return (a.vectors @ b.vectors[places].T).astype(np.int64)
    out = np.zeros(needed.shape, dtype=np.int64)
    rows, columns = np.nonzero(needed)
    for s in range(0, len(rows), PAIRS):
        i, j = rows[s : s + PAIRS], columns[s : s + PAIRS]
        x, y = a.vectors[i], b.vectors[places[j]]
        safe = a.norms[i] * b.norms[places[j]] < DOUBLE_EXACT / 2
        scores = np.where(safe, np.einsum("ij,ij->i", x, y), 0).astype(np.int64)
        for n in np.flatnonzero(~safe).tolist():
            scores[n] = sum(int(u) * int(v) for u, v in zip(x[n].tolist(), y[n].tolist()))
        out[i, j] = scores
    return out


def _real(limits: Sequence) -> np.ndarray:
    return np.array(limits, dtype=np.float64)[:, None]


def _whole(limits: Sequence) -> np.ndarray:
    ends = np.iinfo(np.int64)
    return np.array([int(min(max(x, ends.min), ends.max)) for x in limits], dtype=np.int64)[:, None]


def _kth(values: np.ndarray, k: int, none) -> np.ndarray:
    """The k-th greatest value of each row, or ``none`` in rows of fewer."""
    if values.shape[1] < k:
        return np.full(len(values), none)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def best_pairs(
    a: Summaries, b: Summaries, allowed: np.ndarray, owner: np.ndarray, low_limit: Sequence, high_limit: Sequence, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best scores of each query within its limits, with all ties of the k-th.

    Query ``n`` scores row ``owner[n]`` of ``a`` (owners ascend) with those rows of ``b`` that
    ``allowed[owner[n]]`` permits, from ``low_limit[n]`` to ``high_limit[n]`` (whole numbers).
    Returned are numbers of queries, places in ``b`` and scores.

    At each level a pair is given up when its bounds leave the query's limits, or when its upper
    bound is less than the k-th greatest lower bound of pairs that are surely within the limits.
    Rows of ``b`` that no query needs any more are not refined; of the rest, only needed pairs are
    scored.
    """
    places = np.arange(len(b.vectors))
    nothing = (np.zeros(0, dtype=np.int64),) * 3
    # Bounds are not whole: half a unit keeps every whole score within the limits, and doubles of large
    # limits may be off by a little, which counts against a pair only if it must be within them surely.
    least, most = _real(low_limit) - 0.5, _real(high_limit) + 0.5
    off = [np.where(np.isfinite(x), np.abs(x) * 2.0**-50, 0) for x in (least, most)]
    low, high = np.full(allowed.shape, -np.inf), np.full(allowed.shape, np.inf)
    may = allowed[owner]
    for level in range(len(LEVELS)):
        finer = bounds(a, b, level, places)
        low, high = np.maximum(low, finer[0]), np.minimum(high, finer[1])
        of_low, of_high = low[owner], high[owner]
        may &= (of_high >= least - off[0]) & (of_low <= most + off[1])
        sure = may & (of_low >= least + off[0]) & (of_high <= most - off[1])
        may &= of_high >= _kth(np.where(sure, of_low, -np.inf), k, -np.inf)[:, None]
        used = np.flatnonzero(may.any(axis=0))
        places, may, low, high = places[used], may[:, used], low[:, used], high[:, used]
        if not len(used):
            return nothing
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    needed = np.zeros(low.shape, dtype=bool)
    needed[owner[first]] = np.logical_or.reduceat(may, first, axis=0)
    scores = exact(a, b, places, needed)[owner]
    may &= (scores >= _whole(low_limit)) & (scores <= _whole(high_limit))
    none = np.iinfo(np.int64).min
    may &= scores >= _kth(np.where(may, scores, none), k, none)[:, None]
    query, at = np.nonzero(may)
    return query, places[at], scores[query, at]
