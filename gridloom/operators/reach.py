"""Points within a radius of each other in one block of a frame, without a row per pair.

Points are made distinct and sorted into lines along one axis: points that agree in the other two. From a given point, the
squared distance along a line falls and then rises, rounding included, so the points of a line within the radius are an interval,
whose ends are searched with the very test a join would make. Work goes by points times lines in reach, not by pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from gridloom.operators.components import _hung

#: Points times lines that are looked at together, about.
AT_ONCE = 1 << 19


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, .. of each i, n[i] of them."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(first - (ends - n), n)


def _chunks(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of runs that add up to about AT_ONCE."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield at, upto
        at = upto


def distinct(points: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of ``points`` (3, n) by lines, places in it where another position begins)."""
    others = [a for a in range(3) if a != axis]
    order = np.lexsort((points[axis], points[others[1]], points[others[0]]))
    s = points[:, order]
    return order, np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), (s[:, 1:] != s[:, :-1]).any(axis=0)]))


def best_axis(points: np.ndarray, radius: float) -> int:
    """The axis whose lines leave the least to look at."""
    cost = []
    for axis in range(3 if points.size else 0):
        order, first = distinct(points, axis)
        lines = Lines(points[:, order[first]], axis, radius)
        _, cell, n = np.unique(lines.cells, axis=1, return_inverse=True, return_counts=True)
        cost.append(float((n[cell.ravel()] * np.diff(lines.start)).sum()))
    return int(np.argmin(cost)) if cost else 0


class Lines:
    """Distinct positions (3, n), sorted as :func:`distinct` does, and their lines."""

    def __init__(self, at: np.ndarray, axis: int, radius: float):
        self.at, self.axis = at, axis
        others = at[[a for a in range(3) if a != axis]]
        begins = np.flatnonzero(np.concatenate([np.ones(min(1, at.shape[1]), bool), (others[:, 1:] != others[:, :-1]).any(axis=0)]))
        self.start = np.append(begins, at.shape[1])
        self.cells = np.floor(others[:, begins] / (radius * (1 + 1e-6)))
        self.head = at[:, begins].copy()
        self.head[axis] = 0

    def __len__(self) -> int:
        return len(self.start) - 1


def _lines_in_reach(left: Lines, right: Lines, near: Callable) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, line, other): lines first to end of ``left`` with the lines of ``right`` that they reach."""
    u, v = (np.unique(c) for c in right.cells)
    key = np.searchsorted(u, right.cells[0]) * (len(v) + 1) + np.searchsorted(v, right.cells[1])
    by_cell = np.argsort(key, kind="stable")
    key = key[by_cell]
    row, past = np.searchsorted(u, left.cells[0] - 1), np.searchsorted(u, left.cells[0] + 1, "right")
    lo, hi = np.searchsorted(v, left.cells[1] - 1), np.searchsorted(v, left.cells[1] + 1, "right")
    rows = row[:, None] + np.arange(3)
    first = np.searchsorted(key, rows * (len(v) + 1) + lo[:, None])
    n = np.where(rows < past[:, None], np.searchsorted(key, rows * (len(v) + 1) + hi[:, None]) - first, 0)
    for a, b in _chunks(n.sum(axis=1)):
        line = np.repeat(np.arange(a, b), n[a:b].sum(axis=1))
        other = by_cell[ranges(first[a:b].ravel(), n[a:b].ravel())]
        met = near(_d2(left.head[:, line], right.head[:, other]))
        yield a, b, line[met], other[met]


def _meetings(left: Lines, right: Lines, near: Callable, later: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(positions of ``left``, where each begins, position, line of ``right``) of positions and the lines they may reach; ``later``: lines of a greater number only."""
    for a, b, line, other in _lines_in_reach(left, right, near):
        if later:
            line, other = line[other > line], other[other > line]
        n = np.bincount(line - a, minlength=b - a)
        size = np.diff(left.start[a : b + 1])
        first, each = np.repeat(np.cumsum(n) - n, size), np.repeat(n, size)
        place = np.arange(left.start[a], left.start[b])
        first, place, each = first[each > 0], place[each > 0], each[each > 0]
        for c, d in _chunks(each):
            yield place[c:d], np.cumsum(each[c:d]) - each[c:d], np.repeat(place[c:d], each[c:d]), other[ranges(first[c:d], each[c:d])]


def _first_not(right: Lines, line: np.ndarray, guess: np.ndarray, before: Callable) -> np.ndarray:
    """The first position of each line that ``before(positions, rows)`` does not hold for (the line's end, if none); it holds for those ahead of it."""
    lo, hi = right.start[line], right.start[line + 1]
    at = np.clip(guess, lo, hi)
    every = slice(None)
    off = (at > lo) & ~before(np.maximum(at - 1, 0), every) | (at < hi) & before(np.minimum(at, right.at.shape[1] - 1), every)
    rows = np.flatnonzero(off)
    lo, hi = lo[rows], hi[rows]
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, right.at.shape[1] - 1)
        ahead = (lo < hi) & before(mid, rows)
        lo, hi = np.where(ahead, mid + 1, lo), np.where(ahead | (lo >= hi), hi, mid)
    at[rows] = lo
    return at


def _keys(right: Lines) -> tuple[np.ndarray, Callable]:
    """Numbers that ascend over all lines, about, and those of places on them."""
    at = right.at[right.axis]
    low, span = (at.min(), at.max() - at.min() + 2) if len(at) else (0.0, 2.0)
    of = lambda line, x: line * span + np.clip(x - low, -0.5, span - 1)
    return of(np.repeat(np.arange(len(right)), np.diff(right.start)), at), of


def _intervals(left: Lines, right: Lines, limit: float, later: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
    """(positions, where each begins, position, first, end): what lies within ``limit`` (squared) on each line in reach."""
    keys, of = _keys(right)
    x = right.at[right.axis]
    near = lambda d2: d2 <= limit
    for places, begins, p, line in _meetings(left, right, near, later):
        a = left.at[:, p]
        mine = a[left.axis]
        half = np.sqrt(np.maximum(limit - _d2(left.head[:, np.searchsorted(left.start, p, "right") - 1], right.head[:, line]), 0))
        out = lambda i, rows: ~near(_d2(a[:, rows], right.at[:, i]))
        first = _first_not(right, line, np.searchsorted(keys, of(line, mine - half)), lambda i, rows: (x[i] < mine[rows]) & out(i, rows))
        end = _first_not(right, line, np.searchsorted(keys, of(line, mine + half), "right"), lambda i, rows: (x[i] <= mine[rows]) | ~out(i, rows))
        yield places, begins, p, first, end


def counts(left: Lines, right: Lines, weights: np.ndarray, radius: float) -> np.ndarray:
    """Sum of ``weights`` of ``right`` within ``radius`` of each position of ``left``."""
    upto, found = np.append(0, np.cumsum(weights)), np.zeros(left.at.shape[1], np.int64)
    for places, begins, _, first, end in _intervals(left, right, radius**2):
        found[places] += np.add.reduceat(upto[end] - upto[first], begins)
    return found


def nearest(left: Lines, right: Lines, rank: np.ndarray, radius: float) -> np.ndarray:
    """The position of ``right`` nearest to each of ``left`` and nearer than ``radius``, of equally near ones that of the least ``rank``; -1: none."""
    limit = radius**2
    keys, of = _keys(right)
    x = right.at[right.axis]
    by_rank = np.argsort(rank)
    none = len(rank)
    found = np.full(left.at.shape[1], none)
    for places, begins, p, line in _meetings(left, right, lambda d2: d2 < limit):
        a = left.at[:, p]
        mine = a[left.axis]
        at = _first_not(right, line, np.searchsorted(keys, of(line, mine)), lambda i, rows: x[i] < mine[rows])
        lo, hi = right.start[line], right.start[line + 1]
        sides = [(np.where(at > lo, at - 1, -1), -1), (np.where(at < hi, at, -1), 1)]
        d2 = [np.where(i >= 0, _d2(a, right.at[:, i]), np.inf) for i, _ in sides]
        best = np.minimum.reduceat(np.minimum(*d2), begins)
        least = np.repeat(best, np.diff(np.append(begins, len(p))))
        for (i, step), d in zip(sides, d2, strict=True):
            rows = np.flatnonzero((d == least) & (least < limit))
            # further ones may round to the same distance
            while len(rows):
                np.minimum.at(found, p[rows], rank[i[rows]])
                i[rows] += step
                rows = rows[(i[rows] >= lo[rows]) & (i[rows] < hi[rows])]
                rows = rows[_d2(a[:, rows], right.at[:, i[rows]]) == least[rows]]
    return np.where(found < none, np.append(by_rank, -1)[found], -1)


def clusters(cores: Lines, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(run of each position, component of each run): runs are neighbours in a row on a line, components what the radius connects, named by a run."""
    limit, m = radius**2, cores.at.shape[1]
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.append(True, _d2(cores.at[:, 1:], cores.at[:, :-1]) > limit)
    new[cores.start[:-1]] = True
    run = np.cumsum(new) - 1
    n = int(run[-1]) + 1
    pairs, across = [], np.zeros(n + 1, np.int64)
    for _, _, p, first, end in _intervals(cores, cores, limit, later=True):
        met = end > first
        p, first, last = run[p[met]], run[first[met]], run[end[met] - 1]
        pairs.append(np.unique(p * np.int64(n) + first))
        across += np.bincount(first, minlength=n + 1) - np.bincount(last, minlength=n + 1)
    joined = np.flatnonzero(np.cumsum(across)[:-1] > 0)
    pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
    component = np.arange(n)
    if len(pairs) + len(joined):
        node, least = _hung(np.concatenate([pairs // n, joined]), np.concatenate([pairs % n, joined + 1]))
        component[node] = least
    return run, component


def touched(left: Lines, cores: Lines, run: np.ndarray, component: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(position of ``left``, component of ``cores`` within its reach), each pair once, in order."""
    found, n = [np.zeros(0, np.int64)], np.int64(len(component))
    if n:
        for _, _, p, first, end in _intervals(left, cores, radius**2):
            met = end > first
            p, at, last = p[met], run[first[met]], run[end[met] - 1]
            while len(p):
                found.append(np.unique(p * n + component[at]))
                on = at < last
                p, at, last = p[on], at[on] + 1, last[on]
    found = np.unique(np.concatenate(found))
    return (found // n, found % n) if n else (found, found)
