"""Soft predicates in [0, 1]: operations, combinations and effects of masks, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .math import clamp, in_polygon, mix, polyline_distance, smoothstep, span


def levels(a: Column, black: float, white: float, gamma: float) -> Column:
    return F.pow(clamp((a - black) / max(white - black, 1e-6)), F.lit(1.0 / max(gamma, 1e-6)))


def s_curve(a: Column, contrast: float) -> Column:
    c = max(contrast, 0.0)
    t = clamp(a)
    return t + (t * t * (3.0 - 2.0 * t) - t) * (c / (1.0 + c))


#: Operations on two masks; the last ones read the first only.
OPS: dict[str, Callable[..., Column]] = {
    "add": lambda a, b, amount=1.0: clamp(a + b * amount),
    "subtract": lambda a, b, amount=1.0: clamp(a - b * amount),
    "multiply": lambda a, b, amount=1.0: clamp(a * (b * amount + (1.0 - amount))),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
    "invert": lambda a, b: 1.0 - a,
    "clamp": lambda a, b, lo=0.0, hi=1.0: clamp(a, lo, hi),
    "levels": lambda a, b, black=0.0, white=1.0, gamma=1.0: levels(a, black, white, gamma),
    "smoothstep": lambda a, b, lo=0.0, hi=1.0: smoothstep(lo, hi, a),
    "remap": lambda a, b, lo=0.0, hi=1.0: F.lit(lo) + a * (hi - lo),
}

COMBINES: dict[str, Callable[[Column, Column], Column]] = {
    "multiply": lambda a, b: clamp(a * b),
    "add": lambda a, b: clamp(a + b),
    "subtract": lambda a, b: clamp(a - b),
    "min": F.least,
    "max": F.greatest,
    "replace": lambda a, b: clamp(b),
    "invert": lambda a, b: clamp(1.0 - a),
    "paint_override": lambda a, b: F.when(b > 1e-4, clamp(b)).otherwise(clamp(a)),
}

PLACEMENTS: dict[str, Callable[[Column, Column], Column]] = {
    "paint_only": lambda m, p: clamp(m),
    "rules_only": lambda m, p: clamp(p),
    "paint_mul_rules": lambda m, p: clamp(m) * clamp(p),
    "paint_add_rules": lambda m, p: clamp(clamp(m) + clamp(p)),
    "paint_overrides_rules": lambda m, p: F.when(clamp(m) > 1e-4, clamp(m)).otherwise(clamp(p)),
}


def effect(kind: str, x: Column, opacity: float = 1.0, **p) -> Column:
    """A pointwise mask effect, blended over its input."""
    made = {
        "invert": lambda: 1.0 - x,
        "levels": lambda: levels(x, p["black"], max(p["white"], p["black"] + 1e-6), p["gamma"]),
        "remap": lambda: span(x, p["lo"], p["hi"]),
        "contrast": lambda: clamp((x - 0.5) * max(p["amount"], 0.0) + 0.5),
        "clamp": lambda: clamp(x, p["lo"], p["hi"]),
        "curve": lambda: s_curve(x, p["contrast"]),
        "smoothstep": lambda: _soft(span(x, p["lo"], p["hi"])),
    }[kind]()
    return clamp(mix(x, made, opacity))


def _soft(t: Column) -> Column:
    return t * t * (3.0 - 2.0 * t)


def fold(children: list[Column], every: bool) -> Column:
    """All: the product; Any: the largest."""
    out = children[0]
    for c in children[1:]:
        out = out * c if every else F.greatest(out, c)
    return out


def sea_level(h: Column, level: float, width: float) -> Column:
    return clamp(1.0 - F.abs(h - level) / max(width, 1e-3))


def above(v: Column, at: float, falloff: float) -> Column:
    return F.when(v >= at, 1.0).otherwise(clamp(1.0 - (at - v) / max(falloff, 1e-6)))


def below(v: Column, at: float, falloff: float) -> Column:
    return F.when(v <= at, 1.0).otherwise(clamp(1.0 - (v - at) / max(falloff, 1e-6)))


def between(v: Column, lo: float, hi: float, falloff: float) -> Column:
    return F.least(above(v, lo, falloff), below(v, hi, falloff))


def polygon(u: Column, v: Column, points: list[tuple[float, float]], soft: float) -> Column:
    """1 inside a polygon, falling to 0 over soft outside it; 1 everywhere for fewer than three points."""
    if len(points) < 3:
        return F.lit(1.0)
    inside = in_polygon(u, v, points, floored=True)
    outside = F.lit(0.0) if soft <= 1e-6 else clamp(1.0 - polyline_distance(u, v, points, True) / soft)
    return F.when(inside, 1.0).otherwise(outside)


def ribbon(u: Column, v: Column, points: list[tuple[float, float]], width: float) -> Column:
    """1 on a polyline, falling to 0 over width; 0 for fewer than two points."""
    return F.lit(0.0) if len(points) < 2 else clamp(1.0 - polyline_distance(u, v, points) / max(width, 1e-5))


#: Fields of a landscape that a mask may read by name, besides any other; a field that is not there at all counts as full, hardness as none.
FIELD_SOURCES = ("wetness", "sediment", "erosion", "deposition", "hardness", "temperature", "rainfall", "humidity", "snow", "soil_moisture", "wind_exposure", "painted", "layer_output", "named")


def field_masks(df: DataFrame, fields: DataFrame, names: tuple[str, ...] = FIELD_SOURCES) -> DataFrame:
    """df with a mask for each named field of (i, j, field, value); 0 where a field has no value for a cell.

    All masks come from one pivot, so that any number of them costs one shuffle.
    """
    value = lambda n: F.max(F.when(F.col("field") == n, F.col("value"))).alias(n)
    own = fields.where(F.col("field").isin(*names))
    there = {r.field for r in own.select("field").distinct().collect()}  # names at most
    wide = own.groupBy("i", "j").agg(*map(value, names))
    fill = lambda n: F.coalesce(F.col(n), F.lit(0.0)) if n in there else F.lit(0.0 if n == "hardness" else 1.0)
    return df.join(wide, ["i", "j"], "left").withColumns({n: fill(n) for n in names})
