"""Lattice noise as Columns.

A hash step uses its argument several times, and nesting such steps would grow
an expression exponentially. ``Let`` therefore binds each step to a column of its own:
steps that do not depend on each other share one projection, so a field of many
octaves is a dozen projections that fuse into one stage of generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .math import clamp, fade, lerp, remap

MASK = (1 << 32) - 1
#: Multipliers of the 32-bit avalanche, and the seed's second half for cell points. Fixed values.
AVALANCHE = (0x7FEB352D, 0x846CA68B)
SECOND_SEED = 0xA5A5A5A5


def hash_int(x: int) -> int:
    """The 32-bit avalanche of a driver-side number."""
    x ^= x >> 16
    x = x * AVALANCHE[0] & MASK
    x ^= x >> 15
    x = x * AVALANCHE[1] & MASK
    return x ^ x >> 16


def seed32(seed: int) -> int:
    """A 64-bit seed folded to 32 bits; a small seed stays."""
    seed &= (1 << 64) - 1
    return (seed & MASK) ^ hash_int(seed >> 32)


class Let:
    """Binds expressions to temporary columns, level by level."""

    def __init__(self, df: DataFrame):
        self.df, self.own, self.pending = df, list(df.columns), {}
        self.count = 0

    def __call__(self, *exprs: Column) -> list[Column]:
        """Bound columns of the expressions, which become one projection."""
        names = [f"__let{self.count + k}" for k in range(len(exprs))]
        self.count += len(exprs)
        self.df = self.df.withColumns(dict(zip(names, exprs, strict=True)))
        return [F.col(n) for n in names]

    def done(self, **columns: Column) -> DataFrame:
        """The frame with the given columns and without the temporary ones."""
        keep = [F.col(c) for c in self.own if c not in columns]
        return self.df.select(*keep, *(c.alias(n) for n, c in columns.items()))


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2**32, in halves so that nothing overflows 64 bits."""
    low = x.bitwiseAND(0xFFFF) * k
    high = F.shiftleft((F.shiftright(x, 16) * k).bitwiseAND(0xFFFF), 16)
    return (low + high).bitwiseAND(MASK)


def hash_many(let: Let, xs: list[Column]) -> list[Column]:
    """The 32-bit avalanche of each, in step."""
    xs = let(*(x.bitwiseXOR(F.shiftright(x, 16)) for x in xs))
    xs = let(*(_times(x, AVALANCHE[0]) for x in xs))
    xs = let(*(x.bitwiseXOR(F.shiftright(x, 15)) for x in xs))
    xs = let(*(_times(x, AVALANCHE[1]) for x in xs))
    return let(*(x.bitwiseXOR(F.shiftright(x, 16)) for x in xs))


def lattice_hash(let: Let, points: list[tuple[Column, Column, int]]) -> list[Column]:
    """Hash of each (ix, iz, 32-bit seed); coordinates are whole numbers, negative ones as 32-bit patterns."""
    first = hash_many(let, let(*(ix.cast("long").bitwiseAND(MASK).bitwiseXOR(F.lit(s).cast("long")) for ix, _, s in points)))
    return hash_many(let, let(*(h.bitwiseXOR(iz.cast("long").bitwiseAND(MASK)) for h, (_, iz, _) in zip(first, points, strict=True))))


def unit(h: Column) -> Column:
    return h.cast("double") / float(MASK)


def _gradient4(h: Column, x: Column, z: Column) -> Column:
    k = h.bitwiseAND(3)
    return F.when(k == 0, x + z).when(k == 1, -x + z).when(k == 2, x - z).otherwise(-x - z)


def _gradient8(h: Column, x: Column, z: Column) -> Column:
    k = h.bitwiseAND(7)
    return F.when(k == 0, x + z).when(k == 1, -x + z).when(k == 2, x - z).when(k == 3, -x - z).when(k == 4, x).when(k == 5, -x).when(k == 6, z).otherwise(-z)


def _cells(let: Let, at: list[tuple[Column, Column, int]]):
    """Bound coordinates, cell corners and corner hashes of every sample."""
    flat = let(*(c for x, z, _ in at for c in (x, z)))
    xs, zs = flat[::2], flat[1::2]
    floors = let(*(F.floor(c) for c in flat))
    ix, iz = floors[::2], floors[1::2]
    corners = [(a + di, b + dj, seed32(s)) for a, b, (_, _, s) in zip(ix, iz, at, strict=True) for dj in (0, 1) for di in (0, 1)]
    hashes = lattice_hash(let, corners)
    fr = let(*(c - f.cast("double") for c, f in zip(flat, floors, strict=True)))
    return xs, zs, fr[::2], fr[1::2], [hashes[4 * k : 4 * k + 4] for k in range(len(at))]


def perlin(let: Let, at: list[tuple[Column, Column, int]]) -> list[Column]:
    """Gradient noise times the square root of 2 at each (x, z, seed)."""
    _, _, fx, fz, corners = _cells(let, at)
    out = []
    for x, z, (a, b, c, d) in zip(fx, fz, corners, strict=True):
        low = lerp(_gradient4(a, x, z), _gradient4(b, x - 1.0, z), fade(x))
        high = lerp(_gradient4(c, x, z - 1.0), _gradient4(d, x - 1.0, z - 1.0), fade(x))
        out.append((low, high, fade(z)))
    bound = let(*(e for t in out for e in t))
    return let(*(lerp(bound[3 * k], bound[3 * k + 1], bound[3 * k + 2]) * math.sqrt(2.0) for k in range(len(at))))


def value(let: Let, at: list[tuple[Column, Column, int]]) -> list[Column]:
    """Value noise in [-1, 1]."""
    _, _, fx, fz, corners = _cells(let, at)
    bound = let(*(e for x, z, (a, b, c, d) in zip(fx, fz, corners, strict=True) for e in (unit(a) * 2.0 - 1.0, unit(b) * 2.0 - 1.0, unit(c) * 2.0 - 1.0, unit(d) * 2.0 - 1.0, fade(x), fade(z))))
    return let(*(lerp(lerp(a, b, u), lerp(c, d, u), v) for a, b, c, d, u, v in (bound[6 * k : 6 * k + 6] for k in range(len(at)))))


#: Skew factors of the triangular lattice. Fixed values.
SKEW, UNSKEW = 0.3660254, 0.21132487


def simplex(let: Let, at: list[tuple[Column, Column, int]]) -> list[Column]:
    """Noise on a skewed triangular lattice, times 40."""
    flat = let(*(c for x, z, _ in at for c in (x, z)))
    pairs = list(zip(flat[::2], flat[1::2], strict=True))
    ij = let(*(e for x, z in pairs for e in (F.floor(x + (x + z) * SKEW), F.floor(z + (x + z) * SKEW))))
    near = let(*(e for (x, z), i, j in zip(pairs, ij[::2], ij[1::2], strict=True) for e in (x - (i - (i + j) * UNSKEW), z - (j - (i + j) * UNSKEW))))
    points, corners = [], []
    for (i, j), (x, z), (_, _, s) in zip(zip(ij[::2], ij[1::2], strict=True), zip(near[::2], near[1::2], strict=True), at, strict=True):
        right = (x > z).cast("int")
        points += [(i, j, seed32(s)), (i + right, j + (1 - right), seed32(s)), (i + 1, j + 1, seed32(s))]
        corners += [(x, z), (x - right + UNSKEW, z - (1 - right) + UNSKEW), (x - 1.0 + 2.0 * UNSKEW, z - 1.0 + 2.0 * UNSKEW)]
    hashes = lattice_hash(let, points)
    xz = let(*(c for p in corners for c in p))
    ts = let(*(0.5 - x * x - z * z for x, z in zip(xz[::2], xz[1::2], strict=True)))
    parts = let(*(F.when(t < 0, 0.0).otherwise((t * t) * (t * t) * _gradient8(h, x, z)) for t, h, x, z in zip(ts, hashes, xz[::2], xz[1::2], strict=True)))
    return let(*((parts[3 * k] + parts[3 * k + 1] + parts[3 * k + 2]) * 40.0 for k in range(len(at))))


METRICS = {
    "euclidean": lambda dx, dz: F.sqrt(dx * dx + dz * dz),
    "manhattan": lambda dx, dz: F.abs(dx) + F.abs(dz),
    "chebyshev": lambda dx, dz: F.greatest(F.abs(dx), F.abs(dz)),
}


def worley(let: Let, x: Column, z: Column, seed: int, metric: str = "euclidean") -> tuple[Column, Column]:
    """Distances to the nearest and second nearest cell point among 3 by 3 cells."""
    x, z = let(x, z)
    ix, iz = let(F.floor(x), F.floor(z))
    s = seed32(seed)
    cells = [(ix + di, iz + dj) for dj in (-1, 0, 1) for di in (-1, 0, 1)]
    hashes = lattice_hash(let, [(a, b, t) for t in (s, s ^ SECOND_SEED) for a, b in cells])
    gaps = let(*(e for k, (a, b) in enumerate(cells) for e in (x - (a.cast("double") + unit(hashes[k])), z - (b.cast("double") + unit(hashes[9 + k])))))
    (near,) = let(F.array_sort(F.array(*(METRICS[metric](dx, dz) for dx, dz in zip(gaps[::2], gaps[1::2], strict=True)))))
    return tuple(let(near[0], near[1]))


KINDS = {"value": value, "perlin": perlin, "simplex": simplex}


@dataclass(frozen=True)
class Fractal:
    """Parameters of a fractal field."""

    seed: int = 1
    frequency: float = 0.002
    amplitude: float = 120.0
    octaves: int = 1
    lacunarity: float = 2.0
    persistence: float = 0.5
    offset_x: float = 0.0
    offset_z: float = 0.0
    remap_min: float = -1.0
    remap_max: float = 1.0

    def samples(self, x: Column, z: Column, stride: int) -> list[tuple[Column, Column, int]]:
        """Where and with which seed each octave is sampled."""
        return [((x + self.offset_x) * f, (z + self.offset_z) * f, self.seed + o * stride) for o, (f, _) in enumerate(self.levels())]

    def levels(self) -> list[tuple[float, float]]:
        """(frequency, amplitude) of each octave."""
        f, a, out = self.frequency, 1.0, []
        for _ in range(max(1, self.octaves)):
            out.append((f, a))
            a *= self.persistence
            f *= self.lacunarity
        return out


def fbm(let: Let, kind: str, x: Column, z: Column, p: Fractal) -> Column:
    """Octave sum over its own weight, remapped; all octaves are hashed in step."""
    total = sum(n * a for n, (_, a) in zip(KINDS[kind](let, p.samples(x, z, 1013)), p.levels(), strict=True))
    return remap(total / sum(a for _, a in p.levels()), p.remap_min, p.remap_max, -1.0, 1.0) * p.amplitude


def ridged(let: Let, kind: str, x: Column, z: Column, p: Fractal) -> Column:
    """Ridged multifractal in [0, amplitude]; each octave is weighted by the one before."""
    total, weight = F.lit(0.0), F.lit(1.0)
    for n, (_, a) in zip(KINDS[kind](let, p.samples(x, z, 9173)), p.levels(), strict=True):
        ridge = clamp(1.0 - F.abs(n))
        (signal,) = let(ridge * ridge * weight)
        weight, total = clamp(signal * 2.0), total + signal * a
    return clamp(total / sum(a for _, a in p.levels())) * p.amplitude


def billow(let: Let, x: Column, z: Column, p: Fractal, stride: int = 6151) -> Column:
    """Octave sum of absolute gradient noise, in [0, 1]."""
    total = sum(F.abs(n) * a for n, (_, a) in zip(perlin(let, p.samples(x, z, stride)), p.levels(), strict=True))
    return clamp(total / sum(a for _, a in p.levels()))


def domain_warp(let: Let, x: Column, z: Column, p: Fractal, strength: float, frequency: float) -> Column:
    """fBm of gradient noise at places shifted by gradient noise."""
    wx, wz = perlin(let, [((x + p.offset_x) * frequency, (z + p.offset_z) * frequency, p.seed), ((x + p.offset_x) * frequency + 19.1, (z + p.offset_z) * frequency + 7.3, p.seed + 1)])
    x, z = let(x + wx * strength, z + wz * strength)
    return fbm(let, "perlin", x, z, p)


def cell_feature(let: Let, x: Column, z: Column, p: Fractal, feature: str = "f1", metric: str = "euclidean") -> Column:
    """Worley feature f1, f2 or f2-f1, from 0 to 1.2 remapped to the parameters' range."""
    f1, f2 = worley(let, (x + p.offset_x) * p.frequency, (z + p.offset_z) * p.frequency, p.seed, metric)
    v = {"f1": f1, "f2": f2, "f2-f1": f2 - f1}[feature]
    return remap(v, 0.0, 1.2, p.remap_min, p.remap_max) * p.amplitude


def mask_noise(let: Let, kind: str, x: Column, z: Column, seed: int, frequency: float, octaves: int = 3) -> Column:
    """Mask noise in [0, 1] by kind: perlin, ridged, billow or worley; octaves double and halve."""
    p = Fractal(seed=seed, frequency=max(frequency, 1e-6), amplitude=1.0, octaves=octaves)
    if kind == "worley":
        f1, _ = worley(let, x * p.frequency, z * p.frequency, seed)
        return clamp(f1 / 1.2)
    if kind == "ridged":
        total, weight = F.lit(0.0), F.lit(1.0)
        for n, (_, a) in zip(perlin(let, p.samples(x, z, 9173)), p.levels(), strict=True):
            (signal,) = let((1.0 - F.abs(n)) * (1.0 - F.abs(n)) * weight)
            weight, total = clamp(signal * 2.0), total + signal * a
        return clamp(total / sum(a for _, a in p.levels()))
    if kind == "billow":
        return billow(let, x, z, p)
    total = sum(n * a for n, (_, a) in zip(perlin(let, p.samples(x, z, 1013)), p.levels(), strict=True))
    return clamp(total / sum(a for _, a in p.levels()) * 0.5 + 0.5)
