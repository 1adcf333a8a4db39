"""Content-defined anchors: how equal byte strings of one length meet without a row for every byte.

A window is ``LENGTH`` bytes. Its anchor is the smallest hash of the ``GRAM``-byte strings in it, so equal windows have equal
anchors wherever they stand. Consecutive windows of one anchor at one place form a run; a run is one row: the anchor, a hash of
the run's bytes, and its place. Only runs of one anchor can share a window.
"""

from __future__ import annotations

import numpy as np

LENGTH, GRAM, MOST_RUN, SEGMENT, SEED = 100, 40, 64, 1 << 19, 20240229
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_kept: dict[str | int, np.ndarray] = {}


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "up" not in _kept or len(_kept["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _kept[name] = np.cumprod(p, dtype=np.uint64)
    if seed not in _kept:
        _kept[seed] = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _kept["up"], _kept["down"], _kept[seed]


def scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the texts that end at ``ends`` in ``data``: anchor, hash of the run's bytes, first window, number of windows."""
    n = len(data)
    if n < length:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    up, down, table = _powers(max(n + 1, SEGMENT + length), seed)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up[:n], dtype=np.uint64, out=sums[1:])
    grams = scramble((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    width, m, have = length - gram + 1, grams, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    # m[i] is the anchor of the window at i; a window that crosses the end of a text is none.
    inside = np.ones(len(m), bool)
    for e in ends[:-1]:
        inside[max(0, e - length + 1) : e] = False
    fresh = np.ones(len(m), bool)
    # A window that begins with its anchor is the last of its run: the next has another one, or another place of the same. So no run repeats a window.
    fresh[1:] = (m[1:] != m[:-1]) | (inside[1:] != inside[:-1]) | (grams[: len(m) - 1] == m[:-1])
    at = np.flatnonzero(fresh)
    count = np.diff(np.append(at, len(m)))
    keep = inside[at]
    at, count = at[keep], count[keep]
    if (count > MOST_RUN).any():
        parts = -(-count // MOST_RUN)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, count = np.repeat(at, parts) + nth * MOST_RUN, np.minimum(np.repeat(count, parts) - nth * MOST_RUN, MOST_RUN)
    body = scramble((sums[at + count + length - 1] - sums[at]) * down[at] + count.astype(np.uint64))
    return m[at], body, at, count
