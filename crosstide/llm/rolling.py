"""Hashes of any substring from one running sum: sum of code(c) * BASE**i, modulo 2**64, moved back to place 0."""

from __future__ import annotations

import numpy as np

from crosstide.llm.common import mix

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), kept for the next call."""
    if len(_powers[base]) < n:
        grown = np.full(max(n, 2 * len(_powers[base])), base)
        grown[0] = 1
        _powers[base] = np.cumprod(grown)
    return _powers[base][:n]


def codes(symbols: np.ndarray) -> np.ndarray:
    return mix(symbols.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def running(coded: np.ndarray) -> np.ndarray:
    """Sums before each place, along the last axis."""
    out = np.zeros((*coded.shape[:-1], coded.shape[-1] + 1), np.uint64)
    np.cumsum(coded * powers(BASE, coded.shape[-1]), axis=-1, out=out[..., 1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the symbols from `start` up to `end`; the same wherever they stand."""
    longest = sums.shape[-1]
    return (sums[..., end] - sums[..., start]) * powers(INVERSE, longest)[start]
