"""Edit distances of many pairs of strings at once: bits of 64 pairs in a word, cell by cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a plane (64 pairs each), where the planes of a row of cells take no more bytes than PLANES; rows of cells that are
#: gone through together, so that their planes stay in a processor's cache.
WORDS, PLANES, STRIP = 4096, 1 << 27, 8


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts end to end, lengths)."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _grid(points: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """A row a text, filled up with -1."""
    out = np.full((len(sizes), width), -1, np.int64)
    out[np.arange(width) < sizes[:, None]] = points
    return out


def edit_distances(left: list[str], right: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(first, d): d[k, j] is the Levenshtein distance of left[first + k] and right[j], in code points. No text is empty. Texts of like lengths should lie together on the left.

    A cell of the table of two strings differs from its neighbours by -1, 0 or 1. The differences downwards and to the
    right are two bits each, and follow from those above and to the left and from whether the letters are equal (Myers'
    rules), so ten operations on words do a cell of 64 pairs. The last row's differences add up to the distances.
    """
    points, sizes = _codes(right)
    own, lengths = _codes(left)
    letters, coded = np.unique(np.append(points, own), return_inverse=True)
    n, words = int(sizes.max()), -(-len(right) // 64)
    grid, at = _grid(coded[: len(points)], sizes, n), np.append(0, np.cumsum(lengths))
    packed = np.zeros((n, words * 8), np.uint8)

    def planes(bits: np.ndarray) -> np.ndarray:
        packed[:, : -(-len(right) // 8)] = np.packbits(bits.T, axis=1, bitorder="little")
        return packed.view(np.uint64).copy()

    used = np.unique(coded[len(points) :])
    equal = np.zeros((n, len(used) + 1, words), np.uint64)  # the last is that of filled up places
    for k, x in enumerate(used):
        equal[:, k] = planes(grid == x)
    inside = planes(grid >= 0)
    step = max(1, min(WORDS, PLANES // (16 * n)) // words)
    for first in range(0, len(left), step):
        some = lengths[first : first + step]
        m, count = int(some.max()), len(some)
        text = _grid(np.searchsorted(used, coded[len(points) :][at[first] : at[first + count]]), some, m)
        shape = (count, words)
        right_up, right_down = np.full((n, *shape), ~np.uint64(0)), np.zeros((n, *shape), np.uint64)
        eq, xv, t = (np.empty(shape, np.uint64) for _ in range(3))
        ends = [np.flatnonzero(some == i + 1) for i in range(m)]
        total = np.empty((count, len(right)), np.int32)
        # A strip ends where a text of the left ends: the row's differences are needed there.
        cuts = sorted({0, m, *range(0, m, STRIP), *(i + 1 for i in range(m) if len(ends[i]))})
        for top, bottom in zip(cuts, cuts[1:]):
            down = [[np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64)] for _ in range(top, bottom)]
            rows = [text[:, i].copy() for i in range(top, bottom)]
            for j in range(n):
                ph, mh, letters_at = right_up[j], right_down[j], equal[j]
                for row, state in zip(rows, down):
                    pv, mv = state
                    letters_at.take(row, 0, eq, "wrap")
                    np.bitwise_or(eq, mv, xv)
                    np.bitwise_or(eq, mh, eq)
                    # What goes on to the right: up in t, down in xv.
                    np.bitwise_or(xv, ph, t)
                    np.invert(t, t)
                    np.bitwise_or(t, mh, t)
                    np.bitwise_and(xv, ph, xv)
                    # What goes on downwards.
                    np.bitwise_or(eq, pv, ph)
                    np.invert(ph, ph)
                    np.bitwise_or(ph, mv, ph)
                    np.bitwise_and(eq, pv, mh)
                    state[0], state[1], t, xv = t, xv, pv, mv
            for k in ends[bottom - 1]:
                total[k] = bottom
                for a in range(0, n, 255):  # sums of bytes
                    up, less = (np.unpackbits((x[a : a + 255, k] & inside[a : a + 255]).view(np.uint8), axis=1, count=len(right), bitorder="little").sum(0, dtype=np.uint8) for x in (right_up, right_down))
                    total[k] += up
                    total[k] -= less
        yield first, total
