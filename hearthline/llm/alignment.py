"""Alignments of word sequences."""

from __future__ import annotations

from bisect import bisect_left
from math import isqrt

import numpy as np


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Least number of words to insert, delete or replace, None if above ``most``.

    Only the band of ``most`` diagonals on either side is aligned: for each number of
    edits the place is kept that each diagonal reaches farthest, and equal words are
    passed over at once. Time goes with the length times the edits, not with the
    product of lengths.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    if n == m and np.array_equal(a, b):
        return 0
    left, right = a.tolist(), b.tolist()
    breaks: dict[int, list[int]] = {}

    def slide(k: int, i: int) -> int:
        """The first place from ``i`` on where diagonal ``k`` (j = i + k) differs."""
        if i >= n or i + k >= m or left[i] != right[i + k]:
            return i
        if k not in breaks:
            low, high = max(0, -k), min(n, m - k)
            breaks[k] = [*(low + np.flatnonzero(a[low:high] != b[low + k : high + k])).tolist(), high]
        places = breaks[k]
        return places[bisect_left(places, i)]

    reached = {0: slide(0, 0)}
    for edits in range(most + 1):
        if reached.get(m - n, -1) >= n:
            return edits
        after: dict[int, int] = {}
        for k in range(max(-edits - 1, -n), min(edits + 1, m) + 1):
            ways = [reached[d] + s for d, s in ((k, 1), (k - 1, 0), (k + 1, 1)) if d in reached]
            i = min(max(ways, default=-1), n, m - k)
            if i >= max(0, -k):
                after[k] = slide(k, i)
        reached = after
    return None


def edits_between(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The same number as ``edits_within``, in less time where there are many edits.

    Equal ends are left out. Few edits are counted by diagonals; more of them by a column
    of differences per word of ``b``, one bit for each word of ``a``, a column at a time.
    """
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    begin = int(differ[0]) if len(differ) else size
    a, b = a[begin:], b[begin:]
    size -= begin
    differ = np.flatnonzero(a[len(a) - size :] != b[len(b) - size :])
    end = size - 1 - int(differ[-1]) if len(differ) else size
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        edits = max(len(a), len(b))
        return edits if edits <= most else None
    few = min(most, 8 + isqrt(len(b) * (1 + len(a) // 4096)))
    edits = edits_within(a, b, few)
    if edits is None and few < most and abs(len(a) - len(b)) <= most:
        edits = _edits_by_columns(a.tolist(), b.tolist())
    return edits if edits is not None and edits <= most else None


def _edits_by_columns(a: list, b: list) -> int:
    places: dict = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, edits = every, 0, len(a)  # along a column, and the number at its end
    for word in b:
        equal = places.get(word, 0) | falls
        diagonal = (((equal & rises) + rises) ^ rises) | equal
        up, down = falls | (every & ~(diagonal | rises)), rises & diagonal  # from column to column
        edits += bool(up & last) - bool(down & last)
        up = up << 1 | 1
        falls = up & diagonal & every
        rises = (down << 1 | ~(diagonal | up)) & every
    return edits


def similarity(a: np.ndarray, b: np.ndarray, least: float, edits_of=edits_within) -> float | None:
    """1 less the edits' share of the longer sequence, None if below ``least``."""
    size = max(len(a), len(b))
    if not size:
        return 1.0
    edits = edits_of(a, b, int((1 - least) * size + 1e-9))
    return None if edits is None else 1 - edits / size
