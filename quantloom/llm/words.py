"""Words of whole texts as 64-bit hashes: runs of other bytes than space and 0x09-0x0D, A-Z lower-cased."""

from __future__ import annotations

import numpy as np

from quantloom.llm.common import mix

_BASE = 0xD6E8FEB86659FD93 | 1
_POWER: list[np.ndarray] = [np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


def _powers(n: int) -> np.ndarray:
    if len(_POWER[0]) < n:
        p = np.full(1 << (n - 1).bit_length(), _BASE, np.uint64)
        p[0] = 1
        _POWER[0] = np.multiply.accumulate(p)
    return _POWER[0][:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text: one more than texts). Words never span texts."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    p = _powers(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * p[:n][::-1], out=c[1:])  # position i weighs _BASE ** (n - 1 - i)
    h = (c[e] - c[s]) * p[e] * np.uint64(pow(_BASE, -n, 1 << 64))
    return mix(h + (e - s).astype(np.uint64)), np.searchsorted(s, offsets)


def shingles(h: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word runs of one text; a shorter text is one run of all its words."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < width:
        return run_hashes(h, n)[:1]
    return np.unique(run_hashes(h, width))


def run_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words in a row."""
    n = len(h) - width + 1
    out = np.full(max(0, n), np.uint64(width))
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(out)
