"""Surface derivatives at a radius: gradients, aspect and the classical curvatures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import clamp
from ..sources.grid import Metrics
from .stencil import along_i, along_j

CURVATURES = ("laplacian", "profile", "plan", "mean", "gaussian")


def _shifted(c: Column, w: Window, step: int) -> Column:
    """The value step cells on, or that of the line's last cell beyond it."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(c, step).over(w), F.last(c).over(whole)) if step > 0 else F.coalesce(F.lag(c, -step).over(w), F.first(c).over(w))


def partials(df: DataFrame, m: Metrics, radius: int = 1, value: str = "h") -> DataFrame:
    """p, q (first) and r, t, s (second) central derivatives over +-radius cells with clamped edges."""
    c, n = F.col(value), radius
    d = df.withColumns({"__dn": _shifted(c, along_j(), -n), "__up": _shifted(c, along_j(), n)})
    d = d.withColumns({f"__{k}{side}": _shifted(F.col(v), along_i(), n * s) for k, v in (("c", value), ("dn", "__dn"), ("up", "__up")) for side, s in (("l", -1), ("r", 1))})
    dx, dz = max(m.dx * n, 1e-6), max(m.dz * n, 1e-6)
    at = F.col
    return d.withColumns(
        {
            "p": (at("__cr") - at("__cl")) / (2.0 * dx),
            "q": (at("__up") - at("__dn")) / (2.0 * dz),
            "r": (at("__cr") - 2.0 * c + at("__cl")) / (dx * dx),
            "t": (at("__up") - 2.0 * c + at("__dn")) / (dz * dz),
            "s": (at("__upr") - at("__dnr") - at("__upl") + at("__dnl")) / (4.0 * dx * dz),
        }
    ).select(*df.columns, "p", "q", "r", "t", "s")


def slope(df: DataFrame, m: Metrics, radius: int = 1) -> DataFrame:
    """slope over 90 degrees, and aspect over a turn."""
    p, q = F.col("p"), F.col("q")
    turn = F.pmod(F.atan2(q, -p), F.lit(2.0 * math.pi)) / (2.0 * math.pi)
    return partials(df, m, radius).select(*df.columns, clamp(F.degrees(F.atan(F.sqrt(p * p + q * q))) / 90.0).alias("slope"), clamp(turn).alias("aspect"))


def signed(df: DataFrame, raw: str, out: str) -> DataFrame:
    """raw over the field's largest absolute value, mapped to [0, 1] around 0.5."""
    top = max(df.agg(F.max(F.abs(F.col(raw)))).first()[0] or 0.0, 1e-6)
    return df.withColumn(out, 0.5 + 0.5 * clamp(F.col(raw) / top, -1.0, 1.0))


def raw_curvatures(df: DataFrame, m: Metrics, radius: int = 1) -> DataFrame:
    p, q, r, t, s = (F.col(k) for k in "pqrts")
    g = p * p + q * q
    steep = g >= 1e-12
    zero = F.lit(0.0)
    made = {
        "laplacian": r + t,
        "profile": F.when(steep, -(r * p * p + 2.0 * s * p * q + t * q * q) / F.greatest(g * F.pow(1.0 + g, F.lit(1.5)), F.lit(1e-12))).otherwise(zero),
        "plan": F.when(steep, -(t * p * p - 2.0 * s * p * q + r * q * q) / F.greatest(F.pow(g, F.lit(1.5)), F.lit(1e-12))).otherwise(zero),
        "mean": ((1.0 + q * q) * r - 2.0 * p * q * s + (1.0 + p * p) * t) / (2.0 * F.pow(1.0 + g, F.lit(1.5))),
        "gaussian": (r * t - s * s) / ((1.0 + g) * (1.0 + g)),
    }
    return partials(df, m, radius).select(*df.columns, *(c.alias(f"raw_{k}") for k, c in made.items()))


def curvatures(df: DataFrame, m: Metrics, radius: int = 1) -> DataFrame:
    """The five curvatures, each signed around 0.5 by one shared reduction, and the mean one's convex and concave parts."""
    d = raw_curvatures(df, m, radius)
    top = d.agg(*(F.max(F.abs(F.col(f"raw_{k}"))).alias(k) for k in CURVATURES)).first()
    d = d.select(*df.columns, *((0.5 + 0.5 * clamp(F.col(f"raw_{k}") / max(top[k] or 0.0, 1e-6), -1.0, 1.0)).alias(k) for k in CURVATURES))
    return d.withColumns({"convex": clamp(F.greatest(F.col("mean") - 0.5, F.lit(0.0)) * 2.0), "concave": clamp(F.greatest(0.5 - F.col("mean"), F.lit(0.0)) * 2.0)})
