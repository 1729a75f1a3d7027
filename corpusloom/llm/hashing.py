"""Vectorised hashes of byte runs: every substring's 64-bit hash from one prefix sum."""

from __future__ import annotations

import numpy as np

# Fixed odd multiplier; its powers and their inverses are kept as far as they were needed, and up to KEPT.
KEPT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# Fixed random weight of each byte value, so that short runs do not collide.
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grown(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, dtype=np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier below ``size`` and their inverses, modulo 2**64."""
    global _powers, _inverses
    if size > KEPT:
        return _grown(_BASE, size), _grown(_INVERSE, size)
    if len(_powers) < size:
        _powers, _inverses = _grown(_BASE, size), _grown(_INVERSE, size)
    return _powers[:size], _inverses[:size]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `run_hash` takes the hash of any run of ``data``."""
    power, _ = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs from ``start`` to before ``end``; equal runs have equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    return mix((sums[end] - sums[start]) * inverse[start])
