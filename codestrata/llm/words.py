"""Hashes of all words of a byte buffer at once, with numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x5851F42D4C957F2D
_VALUES = np.random.default_rng(8).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < count:
        size = max(count, 1 << 16)
        _POWERS[:] = [
            np.cumprod(np.r_[np.uint64(1), np.full(size - 1, factor, np.uint64)], dtype=np.uint64)
            for factor in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words; words end at ASCII white space, A-Z count as a-z."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[raw], True].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):  # whole words, about a block of bytes at a time
        high = max(int(np.searchsorted(ends, starts[low] + block, "right")), low + 1)
        base, stop = starts[low], ends[high - 1]
        power, inverse = _powers(int(stop - base))
        sums = np.r_[np.uint64(0), np.cumsum(_VALUES[_LOWER[raw[base:stop]]] * power[: stop - base], dtype=np.uint64)]
        a, b = starts[low:high] - base, ends[low:high] - base
        hashes[low:high] = mixed((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        low = high
    return starts, ends, hashes
