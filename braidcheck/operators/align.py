"""Unit-cost alignment by furthest-reaching points, all diagonals of a score at once in numpy.

The tie-break fixes how an edit distance splits: for each point the ways substitute,
source only, graph only are tried in this order, and a later one wins only if it gets further in the source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_AMBIGUOUS = np.ones(256, dtype=bool)
_AMBIGUOUS[[ord(c) for c in "ACGTacgt"]] = False
_UPPER = np.array([c - 32 if 97 <= c <= 122 else c for c in range(256)], dtype=np.uint8)
#: Bases compared at once when matches are extended: at first, and at most.
FIRST, MOST = 16, 1 << 14


@dataclass
class Alignment:
    matched: int
    substituted: int
    source_only: int
    graph_only: int
    ambiguous_columns: int
    cells: int

    @property
    def edit_distance(self) -> int:
        return self.substituted + self.source_only + self.graph_only


def _run(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far a from i and b from j agree, for each pair of places."""
    out = np.zeros(len(i), dtype=np.int64)
    room = np.minimum(len(a) - i, len(b) - j)
    on, width = np.flatnonzero(room > 0), FIRST
    while len(on):
        step = np.arange(min(width, int((room[on] - out[on]).max())))
        x, y = i[on] + out[on], j[on] + out[on]
        inside = step < (room[on] - out[on])[:, None]
        same = (a[np.minimum(x[:, None] + step, len(a) - 1)] == b[np.minimum(y[:, None] + step, len(b) - 1)]) & inside
        stop = np.where(same.all(axis=1), len(step), same.argmin(axis=1))
        out[on] += stop
        on = on[(stop == len(step)) & (out[on] < room[on])]
        width = min(width * 4, MOST)
    return out


_ACGT = str.maketrans("", "", "ACGTacgt")


def ambiguous(text: str) -> int:
    """Letters that are not A, C, G or T."""
    return len(text.translate(_ACGT))


def _near(source: str, graph: str) -> Alignment | None:
    """The alignment of texts that one edit at most tells apart, without tables; None for others."""
    a, b = source.upper(), graph.upper()
    n, m = len(a), len(b)
    if a == b:
        return Alignment(n, 0, 0, 0, ambiguous(source), 1)
    if abs(n - m) > 1:
        return None
    # Length of the common beginning, by halves.
    low, high = 0, min(n, m)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    if n == m:
        odd = ambiguous(source) - ambiguous(source[low]) + max(ambiguous(source[low]), ambiguous(graph[low])) if a[low + 1 :] == b[low + 1 :] else -1
        return None if odd < 0 else Alignment(n - 1, 1, 0, 0, odd, 3)
    if n > m:
        return Alignment(m, 0, 1, 0, ambiguous(source), 4) if a[low + 1 :] == b[low:] else None
    return Alignment(n, 0, 0, 1, ambiguous(source) + ambiguous(graph[low]), 2) if a[low:] == b[low + 1 :] else None


def align(source: str, graph: str, max_cells: int = 10_000_000) -> Alignment | None:
    """The alignment, or None if it takes more than max_cells points. Letters are equal in either case."""
    if near := _near(source, graph):
        return near if near.cells <= max_cells else None
    raw_a, raw_b = (np.frombuffer(x.encode(), dtype=np.uint8) for x in (source, graph))
    a, b = _UPPER[raw_a], _UPPER[raw_b]
    n, m = len(a), len(b)
    if max_cells < 1:
        return None
    odd_a, odd_b = _AMBIGUOUS[raw_a], _AMBIGUOUS[raw_b]
    sums = np.concatenate(([0], np.cumsum(odd_a)))
    pad_a, pad_b = np.append(odd_a, False).astype(np.int64), np.append(odd_b, False).astype(np.int64)
    cells, target = 1, n - m
    # A row of numbers per diagonal: place in source (-1: none), matched, substituted, source only, graph only, ambiguous.
    first = int(_run(a, b, np.array([0]), np.array([0]))[0])
    state = np.array([[first, first, 0, 0, 0, sums[first]]], dtype=np.int64)
    if first == n == m:
        return Alignment(*state[0, 1:].tolist(), cells)
    for score in range(1, n + m + 1):
        if cells >= max_cells:
            return None
        wide = np.full((2 * score + 3, 6), 0, dtype=np.int64)
        wide[:, 0] = -1
        wide[2 : 2 * score + 1] = state  # old diagonal d is at row d + score + 1
        diagonals = np.arange(-score, score + 1)
        best = np.full((2 * score + 1, 6), 0, dtype=np.int64)
        best[:, 0] = -1
        for way, old in ((2, wide[1:-1]), (3, wide[:-2]), (4, wide[2:])):
            x = old[:, 0] + (way != 4)
            y = x - diagonals
            ok = (old[:, 0] >= 0) & (x <= n) & (y >= 0) & (y <= m)
            if way == 2:
                ok &= (x > 0) & (y > 0)
                ok &= a[np.clip(x - 1, 0, max(n - 1, 0))] != b[np.clip(y - 1, 0, max(m - 1, 0))] if n and m else False
            on = np.flatnonzero(ok)
            if not len(on):
                continue
            x, y = x[on], y[on]
            new = old[on].copy()
            new[:, way] += 1
            left, right = pad_a[x - 1] if way != 4 else 0, pad_b[y - 1] if way != 3 else 0
            new[:, 5] += np.maximum(left, right)
            run = _run(a, b, x, y)
            new[:, 1] += run
            new[:, 5] += sums[x + run] - sums[x]
            new[:, 0] = x + run
            better = new[:, 0] > best[on, 0]
            best[on[better]] = new[better]
        if abs(target) <= score and best[target + score, 0] == n:
            cells += target + score + 1
            return Alignment(*best[target + score, 1:].tolist(), cells) if cells <= max_cells else None
        cells += 2 * score + 1
        state = best
    return None
