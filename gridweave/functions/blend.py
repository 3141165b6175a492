"""The blend modes of layer compositing, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .math import clamp, col

#: World metres over which the smooth modes round a seam. Fixed value.
SMOOTHNESS = 8.0


def smooth_min(a: Column, b: Column, k: float = SMOOTHNESS) -> Column:
    """Polynomial smooth minimum."""
    h = clamp((b - a) / k * 0.5 + 0.5)
    return b * (1.0 - h) + a * h - h * (1.0 - h) * k


def smooth_max(a: Column, b: Column, k: float = SMOOTHNESS) -> Column:
    return -smooth_min(-a, -b, k)


def _height(a: Column, b: Column) -> Column:
    t = clamp((b - a) * 0.05 + 0.5)
    return a * (1.0 - t) + F.greatest(a, b) * t


MODES: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda a, b: b,
    "replace": lambda a, b: b,
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "min": F.least,
    "max": F.greatest,
    "interpolate": lambda a, b: b,
    "height_blend": _height,
    "overlay": lambda a, b: F.when(a < 0, 2.0 * a * b).otherwise(a + b - a * b / (F.abs(a) + 1.0)),
    "smooth_maximum": smooth_max,
    "smooth_minimum": smooth_min,
    "smooth_union": smooth_max,
    "smooth_subtraction": lambda a, b: smooth_max(a, -b),
}


def blend(mode: str, base: Column, layer: Column, opacity: Column | float = 1.0, mask: Column | float = 1.0) -> Column:
    """base, and the mode's result over it as far as opacity times mask says."""
    w = clamp(col(opacity) * col(mask))
    return base * (1.0 - w) + MODES[mode](base, layer) * w
