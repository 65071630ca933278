"""64-bit hashes of the words of whole texts, without a Python object per word.

A word's bytes (ASCII letters in lower case) are taken eight at a time; each eight are mixed into the state by
a permutation of 64 bits that is not linear, so no two words collide by their structure. The length is the
first state. Words of more than LONG bytes are hashed one by one with xxh3.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes up to which words are hashed in numbers of eight bytes.
LONG = 64
_SPACE = bytes(0 if i in (9, 10, 11, 12, 13, 32) else 1 for i in range(256))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S1, _S2 = np.uint64(32), np.uint64(29)


def _mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers, in place."""
    h ^= h >> _S1
    h *= _M1
    h ^= h >> _S2
    h *= _M2
    h ^= h >> _S1
    return h


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a UTF-8 text (runs of other than ASCII white space), and where each begins."""
    inside = np.frombuffer(b"\0" + text.translate(_SPACE) + b"\0", np.uint8)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = text.lower() + b"\0" * 8
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
    h = _mix(size.astype(np.uint64) * _M2 ^ (eight[start] & _MASK[np.minimum(size, 8)]))
    at = 8
    left = np.flatnonzero((size > at) & (size <= LONG))
    while len(left):
        h[left] = _mix(h[left] * _M1 ^ (eight[start[left] + at] & _MASK[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(low[start[i] : start[i] + size[i]])
    return h, start
