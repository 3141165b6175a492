"""Operators on one cell's own values, as projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import clamp, in_polygon, mix, nearest_int, polyline_distance, smooth01
from ..sources.grid import Metrics, with_world


def plateau(h: Column, low: float, high: float, soft: float) -> Column:
    """Flattens what lies between low and high toward their middle."""
    s = max(soft, 1e-3)
    return (
        F.when(h < low, (low - s) + clamp((h - (low - s)) / s) * s)
        .when(h > high, F.lit(high) + clamp((h - high) / s) * s * 0.25)
        .otherwise(h * 0.25 + (low + high) * 0.5 * 0.75)
    )


def coastal(h: Column, sea: float, beach: float, shelf: float, flatten_below: bool = True) -> Column:
    """A shelf below the sea and a beach above it."""
    b = max(beach, 1e-3)
    t = clamp((h - sea) / b)
    shore = F.when(h < sea + beach, F.lit(sea) + t * t * (3.0 - 2.0 * t) * beach).otherwise(h)
    if not flatten_below:
        return shore
    below = F.lit(sea) if shelf <= 0 else F.lit(sea) - shelf * (1.0 - F.exp(-(sea - h) / b))
    return F.when(h < sea, below).otherwise(shore)


def blocks(h: Column, step: float) -> Column:
    s = max(step, 1.0)
    return nearest_int(h / s) * s


def with_strength(before: Column, after: Column, strength: float, invert: bool = False) -> Column:
    """The share of a filter that is applied; invert turns its change around."""
    s = min(max(strength, 0.0), 1.0)
    return before * (1.0 - s) + (before - (after - before) if invert else after) * s


def sanitise(v: Column) -> Column:
    """NaN and negative values become 0."""
    return F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(0.0))


def root_cohesion(hardness: Column, vegetation: Column, boost: float) -> Column:
    return clamp(hardness + (1.0 - hardness) * boost * clamp(vegetation))


def apply(df: DataFrame, expr: Column, value: str = "h") -> DataFrame:
    return df.withColumn(value, expr)


def polygon_height(df: DataFrame, m: Metrics, points: Sequence[tuple[float, float]], height: float, falloff: float, carve: bool = False, set_elevation: bool = False, floored: bool = False) -> DataFrame:
    """Raises, carves or sets heights inside a polygon in [0, 1], easing out over falloff (a share of the shorter side) beyond its edge; floored as in in_polygon."""
    if len(points) < 3:
        return df
    reach = max(min(max(falloff, 0.0), 0.5) * max(min(m.world_x, m.world_z), 1.0), 1e-3)
    d = with_world(df, m)
    far = polyline_distance(F.col("x"), F.col("z"), [(u * m.world_x, v * m.world_z) for u, v in points], closed=True)
    inside = in_polygon(F.col("x") / m.world_x, F.col("z") / m.world_z, points, floored)
    h = F.col("h")
    target = h - abs(height) if carve else F.lit(float(height)) if set_elevation else h + height
    d = d.withColumn("__w", F.when(inside, 1.0).otherwise(smooth01(1.0 - far / reach)))
    return d.withColumn("h", F.when(F.col("__w") <= 1e-4, h).otherwise(mix(h, target, F.col("__w")))).select(*df.columns)
