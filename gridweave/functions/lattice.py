"""Lattice noise on numpy, for field programs: the same values as in noise.py.

A landform takes dozens of samples. As expressions they exceed what one method
of generated code may hold and would be interpreted row by row; on Arrow batches
each sample is a few dozen vector operations, and the plan stays small.
"""

from __future__ import annotations

import numpy as np

from .noise import AVALANCHE, SECOND_SEED, SKEW, UNSKEW, seed32

_A, _B = (np.uint32(k) for k in AVALANCHE)


def hashed(x: np.ndarray) -> np.ndarray:
    """The 32-bit avalanche."""
    x = x ^ (x >> np.uint32(16))
    x = x * _A
    x ^= x >> np.uint32(15)
    x *= _B
    return x ^ (x >> np.uint32(16))


def lattice(ix: np.ndarray, iz: np.ndarray, seed: int) -> np.ndarray:
    """Hash of whole coordinates under a 32-bit seed."""
    as32 = lambda v: v.astype(np.int64).astype(np.uint32)
    return hashed(hashed(as32(ix) ^ np.uint32(seed)) ^ as32(iz))


def unit(h: np.ndarray) -> np.ndarray:
    return h / 4294967295.0


def _fade(t: np.ndarray) -> np.ndarray:
    return t * t * t * (t * (t * 6.0 - 15.0) + 10.0)


def _corners(x: np.ndarray, z: np.ndarray, seed: int):
    ix, iz = np.floor(x), np.floor(z)
    s = seed32(seed)
    return x - ix, z - iz, [lattice(ix + a, iz + b, s) for b in (0, 1) for a in (0, 1)]


def _slope(h: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.where(h & np.uint32(1), -x, x) + np.where(h & np.uint32(2), -z, z)


def perlin(x: np.ndarray, z: np.ndarray, seed: int) -> np.ndarray:
    fx, fz, (a, b, c, d) = _corners(x, z, seed)
    u, v = _fade(fx), _fade(fz)
    p, q = _slope(a, fx, fz), _slope(c, fx, fz - 1.0)
    low, high = p + (_slope(b, fx - 1.0, fz) - p) * u, q + (_slope(d, fx - 1.0, fz - 1.0) - q) * u
    return (low + (high - low) * v) * np.sqrt(2.0)


def value(x: np.ndarray, z: np.ndarray, seed: int) -> np.ndarray:
    fx, fz, corners = _corners(x, z, seed)
    a, b, c, d = (unit(h) * 2.0 - 1.0 for h in corners)
    u, v = _fade(fx), _fade(fz)
    low, high = a + (b - a) * u, c + (d - c) * u
    return low + (high - low) * v


def simplex(x: np.ndarray, z: np.ndarray, seed: int) -> np.ndarray:
    s = seed32(seed)
    i, j = np.floor(x + (x + z) * SKEW), np.floor(z + (x + z) * SKEW)
    x0, z0 = x - (i - (i + j) * UNSKEW), z - (j - (i + j) * UNSKEW)
    right = (x0 > z0).astype(float)
    total = np.zeros_like(x0)
    for a, b, ex, ez in ((0.0, 0.0, 0.0, 0.0), (right, 1.0 - right, UNSKEW, UNSKEW), (1.0, 1.0, 2.0 * UNSKEW, 2.0 * UNSKEW)):
        px, pz = x0 - a + ex, z0 - b + ez
        k = lattice(i + a, j + b, s) & np.uint32(7)
        t = np.maximum(0.5 - px * px - pz * pz, 0.0)
        total += (t * t) * (t * t) * np.where(k < 4, _slope(k, px, pz), np.choose(k & np.uint32(3), (px, -px, pz, -pz)))
    return total * 40.0


def worley(x: np.ndarray, z: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean distances to the nearest and second nearest cell point."""
    ix, iz, s = np.floor(x), np.floor(z), seed32(seed)
    first = np.full_like(x, np.inf)
    second = first.copy()
    for b in (-1, 0, 1):
        for a in (-1, 0, 1):
            dx = x - (ix + a + unit(lattice(ix + a, iz + b, s)))
            dz = z - (iz + b + unit(lattice(ix + a, iz + b, s ^ SECOND_SEED)))
            d = np.sqrt(dx * dx + dz * dz)
            second = np.minimum(second, np.maximum(first, d))
            first = np.minimum(first, d)
    return first, second


#: Fields by kind: what a sample gives, in the order of its names.
KINDS = {"perlin": perlin, "value": value, "simplex": simplex, "worley": worley, "hash": lambda x, z, seed: lattice(x, z, seed32(seed)).astype(np.int64)}
