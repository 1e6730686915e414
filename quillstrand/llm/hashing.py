"""64-bit hashes of the words of many texts at once, by prefix sums over their bytes."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CODE = np.random.Generator(np.random.PCG64(7)).integers(1 << 62, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TABLES: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; base must be odd."""
    if base not in _TABLES or len(_TABLES[base]) < n:
        with np.errstate(over="ignore"):
            size = max(n, 1 << 16)
            _TABLES[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
    return _TABLES[base][:n]


def scramble(x: np.ndarray) -> np.ndarray:
    """Every bit of the input reaches every bit of the output."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of bytes other than ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[True], SPACE[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(CODE[LOWER[raw]] * powers(BASE, len(raw)), out=sums[1:])
        inverse = powers(pow(BASE, -1, 1 << 64), len(raw) + 1)
        return scramble((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts
