"""Words of many texts at once, as Arrow strings with the number of their text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import bytes_of

#: Bytes of text that are cut into words at once (a longer text is a slice of its own).
SLICE = 1 << 22

#: What each byte becomes: 32 parts words. Terms are ASCII letters in lower case, digits, and all bytes beyond ASCII.
TERM = np.full(256, 32, np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    TERM[_b] = _b
TERM[65:91] = np.arange(97, 123)
#: Words are all between white space, as they are.
WORD = np.arange(256, dtype=np.uint8)
WORD[9:14] = 32


def split(raw: np.ndarray, offsets: np.ndarray, into: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """(the words of texts that lie end to end, the number of each word's text). into: what bytes become."""
    changed = into[raw]
    inside = changed != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    data = changed[inside]
    at = np.append((np.cumsum(inside) - 1)[starts], len(data)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(data))
    return words, np.searchsorted(offsets, starts, "right") - 1


def sliced(column: pa.Array, into: np.ndarray | None = None, size: int = SLICE) -> Iterator[tuple]:
    """(first, last, bytes, offsets) of slices of a column's texts, null as empty; with `into` (first, last, words, of). size: bytes of a slice, where one text has no more."""
    raw, offsets = bytes_of(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        part, at = raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        yield (first, last, *(split(part, at, into) if into is not None else (part, at)))
        first = last


def lists(values: np.ndarray, of: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Sorted rows (of, value) as n lists."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, kind))
