"""Polynomial rolling hashes of byte ranges, for whole buffers at once."""

from __future__ import annotations

import numpy as np

# An odd multiplier and mixing constants.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MIX_A = np.uint64(0xFF51AFD7ED558CCD)
MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
# End of fixed values.

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: A random 64-bit value for each byte, so that near bytes aren't near values.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, for i below n at least."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, dtype=np.uint64), np.full(size, INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        have = _powers[0] = np.cumprod(up), np.cumprod(down)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * MIX_A
    h ^= h >> np.uint64(33)
    h *= MIX_B
    h ^= h >> np.uint64(29)
    return h


def prefix_sums(buffer: np.ndarray) -> np.ndarray:
    """S with S[e] - S[s] = BASE**s times the polynomial of buffer[s:e]."""
    up, _ = powers(len(buffer) + 1)
    out = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[buffer] * up[: len(buffer)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), which depend on their bytes only."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def window_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ranges of a width; one for each start."""
    _, down = powers(len(sums))
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)
