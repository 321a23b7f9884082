"""Word shingles of whole texts as sets of 64-bit hashes, for many texts at once.

Two different words, or two different shingles, have one hash with a chance of about 2 ** -58; sets of hashes are
used in place of sets of shingles, so that is the chance of a wrong element in a comparison.
"""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
SLICE, TEXTS = 1 << 20, 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_MASK = (1 << 64) - 1
_BASE = 0x5851F42D4C957F2D | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_RANDOM = np.frombuffer(b"".join(hashlib.sha256(b"byte %d" % k).digest()[:8] for k in range(256)), np.uint64)
_PLACE = np.frombuffer(b"".join(hashlib.sha256(b"place %d" % k).digest()[:8] for k in range(WORDS)), np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def _table(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for k, b in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * np.uint64(pow(b, m, 1 << 64))])
    return _powers


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, lower-cased A-Z; n + 1 offsets of the texts' words)."""
    white = _WHITE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets] = True
    begins = ~white
    begins[1:] &= white[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    stops = white | first[1:]  # the byte after is not in this word, or this is none
    stops[:-1] |= white[1:]
    ends = np.flatnonzero(stops & ~white) + 1
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + SLICE, "right")))
        a, b = int(starts[k]), int(ends[last - 1])
        power, inverse = _table(b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_RANDOM[_LOWER[raw[a:b]]] * power[: b - a], out=sums[1:])
        s = starts[k:last] - a
        out[k:last] = (sums[ends[k:last] - a] - sums[s]) * inverse[s]
        k = last
    return _mix(out), np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer than five words are one shingle, no words none. Texts are taken a few megabytes at a time, or one at a time if they are longer, which bounds memory."""
    out: list[np.ndarray] = []
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + TEXTS, "right")) - 1)
        out += _some_sets(raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
    return out


def _some_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    words, at = word_hashes(raw, offsets)
    n = len(words) - WORDS + 1
    runs = _mix(sum((words[k : k + n] * _PLACE[k] for k in range(WORDS)), np.zeros(max(0, n), np.uint64))) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64((b - a) * 0xA0761D6478BD642F & _MASK)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def class_id(s: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
