"""Neighbourhood operators on grids, as windows along rows and then along columns.

A window per grid line keeps a task's state to one line and needs two shuffles
for any radius; separable kernels never form the (2r+1)^2 products, and kernels
that are not separable gather their neighbourhood as one array per cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import angle_difference, clamp
from ..sources.grid import Metrics


def along_i():
    """The line of cells through a cell in the direction of i."""
    return Window.partitionBy("j").orderBy("i")


def along_j():
    return Window.partitionBy("i").orderBy("j")


def near4(df: DataFrame, value: str = "h", step: int = 1) -> DataFrame:
    """left, right, down, up: the values at +-step, or at the edge cell beyond the edge."""
    c = F.col(value)
    return df.withColumns({"down": F.coalesce(F.lag(c, step).over(along_j()), F.first(c).over(along_j())), "up": F.coalesce(F.lead(c, step).over(along_j()), _last(c, along_j()))}).withColumns(
        {"left": F.coalesce(F.lag(c, step).over(along_i()), F.first(c).over(along_i())), "right": F.coalesce(F.lead(c, step).over(along_i()), _last(c, along_i()))}
    )


def _last(c: Column, w) -> Column:
    return F.last(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def forward(df: DataFrame, m: Metrics, value: str = "h") -> DataFrame:
    """gx, gz: forward differences by metre, 0 beyond the edge."""
    c = F.col(value)
    dz = (F.coalesce(F.lead(c).over(along_j()), c) - c) / max(m.dz, 1e-5)
    dx = (F.coalesce(F.lead(c).over(along_i()), c) - c) / max(m.dx, 1e-5)
    return df.withColumn("gz", dz).withColumn("gx", dx)


def central(df: DataFrame, m: Metrics, value: str = "h") -> DataFrame:
    """gx, gz: central differences by metre over clamped neighbours."""
    d = near4(df, value)
    return d.withColumns({"gx": (F.col("right") - F.col("left")) / (2.0 * m.dx), "gz": (F.col("up") - F.col("down")) / (2.0 * m.dz)}).drop("left", "right", "down", "up")


def degrees(gx: Column, gz: Column) -> Column:
    return F.degrees(F.atan(F.sqrt(gx * gx + gz * gz)))


def slope_forward(df: DataFrame, m: Metrics) -> DataFrame:
    """slope in degrees from forward differences."""
    return forward(df, m).withColumn("slope", degrees(F.col("gx"), F.col("gz"))).drop("gx", "gz")


def slope_mask(df: DataFrame, m: Metrics) -> DataFrame:
    """slope: central-difference slope over 90 degrees."""
    return central(df, m).withColumn("slope", clamp(degrees(F.col("gx"), F.col("gz")) / 90.0)).drop("gx", "gz")


def aspect_degrees(df: DataFrame, m: Metrics) -> DataFrame:
    a = F.degrees(F.atan2(F.col("gz"), -F.col("gx")))
    return central(df, m).withColumn("aspect", F.pmod(a, F.lit(360.0))).drop("gx", "gz")


def aspect_mask(df: DataFrame, m: Metrics, center: float, width: float) -> DataFrame:
    """Nearness of the aspect to center, falling to 0 over width degrees."""
    t = clamp(1.0 - F.abs(angle_difference(F.col("aspect"), center)) / max(width, 1e-3))
    return aspect_degrees(df, m).withColumn("aspect", t)


def curvature(df: DataFrame, m: Metrics) -> DataFrame:
    """curvature: 0.5 and five times the Laplacian, with convexity and concavity as its halves."""
    d = near4(df)
    lap = (F.col("left") + F.col("right") + F.col("down") + F.col("up") - 4.0 * F.col("h")) / (m.dx * m.dx)
    d = d.withColumn("curvature", clamp(0.5 + lap * 5.0)).drop("left", "right", "down", "up")
    return d.withColumns({"convexity": F.greatest(F.col("curvature") - 0.5, F.lit(0.0)) * 2.0, "concavity": F.greatest(0.5 - F.col("curvature"), F.lit(0.0)) * 2.0})


def edge_magnitude(df: DataFrame, value: str, out: str) -> DataFrame:
    """Length of the difference of opposite neighbours."""
    d = near4(df, value)
    dx, dz = F.col("right") - F.col("left"), F.col("up") - F.col("down")
    return d.withColumn(out, F.sqrt(dx * dx + dz * dz)).drop("left", "right", "down", "up")


def _line_sum(c: Column, w, at: Column, n: int, r: int) -> Column:
    """Sum over +-r of a line, with the edge value as often as the window leaves the line."""
    inside = F.sum(c).over(w.rowsBetween(-r, r))
    first, last = F.first(c).over(w), _last(c, w)
    return inside + first * F.greatest(F.lit(0), r - at) + last * F.greatest(F.lit(0), at + r - (n - 1))


def box_mean(df: DataFrame, m: Metrics, radius: int, value: str = "h", out: str | None = None) -> DataFrame:
    """Mean over a square with clamped edges, separably: two windows whatever the radius."""
    r = max(1, radius)
    d = df.withColumn("__s", _line_sum(F.col(value), along_i(), F.col("i"), m.width, r))
    return d.withColumn("__s", _line_sum(F.col("__s"), along_j(), F.col("j"), m.height, r)).withColumn(out or value, F.col("__s") / float((2 * r + 1) ** 2)).drop("__s")


def shrinking_mean(df: DataFrame, radius: int, iterations: int = 1, value: str = "h") -> DataFrame:
    """Mean over the part of a square that lies inside the grid."""
    for _ in range(max(1, iterations)):
        d = df.withColumns({"__s": F.sum(value).over(along_i().rowsBetween(-radius, radius)), "__n": F.count(F.lit(1)).over(along_i().rowsBetween(-radius, radius))})
        d = d.withColumns({"__s": F.sum("__s").over(along_j().rowsBetween(-radius, radius)), "__n": F.sum("__n").over(along_j().rowsBetween(-radius, radius))})
        df = d.withColumn(value, F.col("__s") / F.col("__n")).drop("__s", "__n")
    return df


def extreme(df: DataFrame, radius: int, pick: str, value: str = "h", out: str | None = None) -> DataFrame:
    """Largest (dilation) or smallest (erosion) value of a square; clamping adds nothing to it."""
    f = {"max": F.max, "min": F.min}[pick]
    r = max(1, radius)
    d = df.withColumn("__e", f(value).over(along_i().rowsBetween(-r, r)))
    return d.withColumn("__e", f("__e").over(along_j().rowsBetween(-r, r))).withColumn(out or value, F.col("__e")).drop("__e")


def neighbourhood(df: DataFrame, m: Metrics, radius: int, value: str = "h", clamped: bool = True) -> DataFrame:
    """near: array of (di, dj, v) over the square, one array per cell from two windows.

    Beyond the edge the edge cell's value is repeated if clamped, else left out.
    """
    r = radius
    d = df.withColumn("__line", F.collect_list(value).over(along_j().rowsBetween(-r, r)))
    d = d.withColumn("__square", F.collect_list("__line").over(along_i().rowsBetween(-r, r)))

    def index(at: Column, step: Column, n: int) -> Column:
        return (F.least(F.greatest(at + step, F.lit(0)), F.lit(n - 1)) - F.greatest(at - r, F.lit(0)) + 1).cast("int")

    offsets = F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for dj in range(-r, r + 1) for di in range(-r, r + 1)))
    if not clamped:
        offsets = F.filter(offsets, lambda o: (F.col("i") + o.di >= 0) & (F.col("i") + o.di < m.width) & (F.col("j") + o.dj >= 0) & (F.col("j") + o.dj < m.height))
    near = F.transform(offsets, lambda o: F.struct(o.di.alias("di"), o.dj.alias("dj"), F.element_at(F.element_at(F.col("__square"), index(F.col("i"), o.di, m.width)), index(F.col("j"), o.dj, m.height)).alias("v")))
    return d.withColumn("near", near).drop("__line", "__square")


def _total(near: str, f) -> Column:
    return F.aggregate(near, F.lit(0.0), lambda s, x: s + f(x))


def occlusion(df: DataFrame, m: Metrics, radius: int, strength: float) -> DataFrame:
    """ao: 1 less the mean positive rise over distance to the cells around, times strength."""
    d = neighbourhood(df, m, max(1, radius), clamped=False)
    d = d.withColumn("near", F.filter("near", lambda x: (x.di != 0) | (x.dj != 0)))
    rise = _total("near", lambda x: F.greatest((x.v - F.col("h")) / F.greatest(F.sqrt((x.di * x.di + x.dj * x.dj).cast("double")), F.lit(1.0)), F.lit(0.0)))
    return d.withColumn("ao", 1.0 - clamp(rise / F.size("near") * strength)).drop("near")


def bilateral(df: DataFrame, m: Metrics, radius: int, sigma_space: float, sigma_range: float) -> DataFrame:
    """Mean weighted by nearness in place and in height."""
    d = neighbourhood(df, m, max(1, radius))
    weight = lambda x: F.exp(-(x.di * x.di + x.dj * x.dj) / (2.0 * max(sigma_space, 0.25) ** 2)) * F.exp(-(x.v - F.col("h")) * (x.v - F.col("h")) / (2.0 * max(sigma_range, 1e-3) ** 2))
    return d.withColumn("h", _total("near", lambda x: x.v * weight(x)) / _total("near", weight)).drop("near")


def despike(df: DataFrame, m: Metrics, radius: int, amount: float) -> DataFrame:
    """The window's median where the height is further than amount from it."""
    d = neighbourhood(df, m, max(1, radius))
    n = (2 * max(1, radius) + 1) ** 2
    mid = F.element_at(F.array_sort(F.transform("near", lambda x: x.v)), n // 2 + 1)
    return d.withColumn("__m", mid).withColumn("h", F.when(F.abs(F.col("h") - F.col("__m")) > amount, F.col("__m")).otherwise(F.col("h"))).drop("near", "__m")


def directional_mean(df: DataFrame, m: Metrics, radius: int, dir_x: float, dir_z: float) -> DataFrame:
    """Gaussian mean along one direction, over the nearest cells of its steps."""
    r = max(1, radius)
    size = max(math.hypot(dir_x, dir_z), 1e-6)
    sigma = max(r * 0.5, 0.5)
    steps = [(_near(dir_x / size * k), _near(dir_z / size * k), math.exp(-k * k / (2.0 * sigma * sigma))) for k in range(-r, r + 1)]
    d = neighbourhood(df, m, r)
    at = lambda di, dj: F.element_at("near", (dj + r) * (2 * r + 1) + di + r + 1).v
    total = sum(at(di, dj) * w for di, dj, w in steps)
    return d.withColumn("h", total / sum(w for *_, w in steps)).drop("near")


def _near(x: float) -> int:
    return math.floor(x + 0.5)  # added to a cell's number, which is not negative


def roughness(df: DataFrame, m: Metrics, radius: int) -> DataFrame:
    """rough: population standard deviation over the square with clamped edges, from two separable means."""
    d = df.withColumns({"__m": F.col("h"), "__q": F.col("h") * F.col("h")})
    d = box_mean(box_mean(d, m, radius, "__m"), m, radius, "__q")
    return d.withColumn("rough", F.sqrt(F.greatest(F.col("__q") - F.col("__m") * F.col("__m"), F.lit(0.0)))).drop("__m", "__q")


def disk_extreme(df: DataFrame, m: Metrics, radius: int, pick: str, value: str, out: str) -> DataFrame:
    """Largest or smallest value of a disk with clamped edges."""
    d = neighbourhood(df, m, radius, value)
    inside = F.filter("near", lambda x: x.di * x.di + x.dj * x.dj <= radius * radius)
    values = F.transform(inside, lambda x: x.v)
    return d.withColumn(out, F.array_max(values) if pick == "max" else F.array_min(values)).drop("near")
