"""Scalar expressions shared by the grid operators; all are Columns, so they stay inside code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def clamp(x: Column, lo: float | Column = 0.0, hi: float | Column = 1.0) -> Column:
    return F.least(F.greatest(x, col(lo)), col(hi))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def mix(a: Column, b: Column, w: Column | float) -> Column:
    return a * (1.0 - col(w)) + b * col(w)


def fade(t: Column) -> Column:
    """Quintic 6t^5 - 15t^4 + 10t^3."""
    return t * t * t * (t * (t * 6.0 - 15.0) + 10.0)


def smooth01(t: Column) -> Column:
    t = clamp(t)
    return t * t * (3.0 - 2.0 * t)


def smoothstep(lo: float, hi: float, x: Column) -> Column:
    return smooth01((x - lo) / max(hi - lo, 1e-6))


def remap(v: Column, in_min: float, in_max: float, out_min: float, out_max: float) -> Column:
    return F.lit(out_min) + clamp((v - in_min) / max(in_max - in_min, 1e-6)) * (out_max - out_min)


def span(v: Column, lo: float, hi: float) -> Column:
    """v's place between lo and hi, in [0, 1]."""
    return clamp((v - lo) / max(hi - lo, 1e-5))


def nearest_int(x: Column) -> Column:
    """Rounds half away from zero."""
    return F.when(x >= 0, F.floor(x + 0.5)).otherwise(-F.floor(0.5 - x))


def angle_difference(a: Column, b: Column | float) -> Column:
    """a - b in degrees, wrapped to [-180, 180]."""
    d = (a - col(b)) % 360.0
    return F.when(d > 180.0, d - 360.0).when(d < -180.0, d + 360.0).otherwise(d)


def segment_distance(px: Column, py: Column, ax: float, ay: float, bx: float, by: float) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = clamp(((px - ax) * dx + (py - ay) * dy) / size) if size > 1e-12 else F.lit(0.0)
    ex, ey = px - (F.lit(ax) + t * dx), py - (F.lit(ay) + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def polyline_distance(px: Column, py: Column, points: Sequence[tuple[float, float]], closed: bool = False) -> Column:
    ring = list(points) + ([points[0]] if closed else [])
    parts = [segment_distance(px, py, *a, *b) for a, b in zip(ring, ring[1:], strict=False)]
    return parts[0] if len(parts) == 1 else F.least(*parts)


def in_polygon(px: Column, py: Column, points: Sequence[tuple[float, float]], floored: bool = False) -> Column:
    """Even-odd test: whether a ray from the point crosses an odd number of edges.

    floored keeps a known deviation that masks of existing documents rest on: the
    height difference of an edge that goes down is taken as 1e-12.
    """
    if len(points) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip([points[-1], *points[:-1]], points, strict=True):
        rise = max(ay - by, 1e-12) if floored else ay - by
        if rise == 0.0:
            continue  # a level edge is not crossed
        between = (F.lit(by) > py) != (F.lit(ay) > py)
        crossings = crossings + (between & (px < bx + (py - by) * ((ax - bx) / rise))).cast("int")
    return crossings % 2 == 1


def metres_to_texels(metres: Column, cell: float) -> Column:
    return metres / cell


def texels_to_metres(texels: Column, cell: float) -> Column:
    return texels * cell


def radius_texels(radius_m: float, cell: float) -> int:
    return max(1, math.ceil(radius_m / max(cell, 1e-6)))


def catmull_rom(a: Column, b: Column, c: Column, d: Column, t: Column) -> Column:
    return 0.5 * (2.0 * b + (c - a) * t + (2.0 * a - 5.0 * b + 4.0 * c - d) * t * t + (3.0 * b - a - 3.0 * c + d) * t * t * t)


def stream_power_step(area: Column, slope: Column, k: float, m: float, n: float, soft: Column | float, dt: float, slope_cap: float, max_step: float) -> tuple[Column, Column]:
    """Stream-power incision K A^m S^n by softness: the rate, and the step that it makes under two caps."""
    rate = k * F.pow(area, F.lit(m)) * F.pow(slope, F.lit(n)) * col(soft)
    return rate, F.least(rate * dt, F.lit(slope_cap), F.lit(max_step))
