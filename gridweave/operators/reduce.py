"""Reductions over grids, and remaps that need one.

A reduction is one row that Spark combines on the map side. Remaps read it as
numbers on the driver, so that they stay projections that fuse with their
neighbours; no grid is joined to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.math import clamp, nearest_int, smoothstep
from ..sources.grid import Metrics


def min_max(df: DataFrame, value: str = "h") -> DataFrame:
    return df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def _range(df: DataFrame, value: str = "h") -> tuple[float, float, float]:
    r = min_max(df, value).first()
    lo, hi = (r.lo, r.hi) if r.lo is not None else (0.0, 0.0)
    return lo, hi, max(hi - lo, 1e-5)


def histogram(df: DataFrame, bins: int, value: str = "h") -> DataFrame:
    """bin, n, fraction over equal widths; the last bin is closed, values that are not finite are skipped, no spread gives empty bins."""
    bins = max(1, bins)
    v = F.col(value)
    finite = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).select(v.cast("double").alias("v"))
    lo, hi, _ = _range(finite, "v")
    if hi - lo < 1e-12:
        finite = finite.limit(0)
    at = F.least(F.floor((F.col("v") - lo) / max(hi - lo, 1e-12) * bins), F.lit(bins - 1)).cast("int")
    counts = finite.groupBy(at.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(counts, every["bin"] == counts["b"], "left").select("bin", F.coalesce("c", F.lit(0)).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # bins rows, fixed by the caller
    return out.withColumn("fraction", F.col("n") / F.greatest(total, F.lit(1)))


#: Equal-width buckets that the ranks of a curve are first looked up in.
BUCKETS = 1 << 16


def hypsometry(df: DataFrame, samples: int, value: str = "h") -> DataFrame:
    """k, area fraction and elevation of equally spaced ranks, low to high.

    Counts by bucket of value (BUCKETS rows at most) say which buckets hold the
    ranks; only the cells of those, one for each rank at most, are ordered, each
    bucket by itself. No cells give no rows.
    """
    samples = min(max(samples, 8), 512)
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("v"))
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, width = (r.lo, max(r.hi - r.lo, 1e-300)) if r.n else (0.0, 1.0)
    v = v.withColumn("b", F.least(F.floor((F.col("v") - lo) / width * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    counts = v.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("end", F.sum("c").over(Window.orderBy("b"))).withColumn("start", F.col("end") - F.col("c"))  # BUCKETS rows at most
    ranks = df.sparkSession.range(samples).select(F.col("id").cast("int").alias("k"), (F.col("id") / (samples - 1)).alias("fraction"))
    ranks = ranks.withColumn("rank", F.least(nearest_int(F.col("fraction") * (r.n - 1)), F.lit(r.n - 1)))
    want = F.broadcast(ranks).join(upto, (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end"))).select("k", "fraction", F.col("b").alias("wb"), (F.col("rank") - F.col("start") + 1).alias("at"))
    held = v.join(F.broadcast(want.select("wb").distinct()), v["b"] == F.col("wb"), "left_semi")  # at most 512 rows
    placed = held.withColumn("at", F.row_number().over(Window.partitionBy("b").orderBy("v")))
    return placed.join(F.broadcast(want), (placed["b"] == want["wb"]) & (placed["at"] == want["at"])).select("k", "fraction", F.col("v").alias("elevation"))


def hypsometric_integral(df: DataFrame, samples: int, value: str = "h") -> DataFrame:
    """The trapezoid integral of relative height over area, with the range, mean and relief."""
    curve = hypsometry(df, samples, value)
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean")).first()
    relief = max(r.hi - r.lo, 1e-6)
    rel = (F.col("elevation") - r.lo) / relief
    w = Window.orderBy("k")
    parts = curve.select((0.5 * (F.lag(rel).over(w) + rel) * (F.col("fraction") - F.lag("fraction").over(w))).alias("a"))
    return parts.agg(F.sum("a").alias("integral")).select("integral", F.lit(r.lo).alias("z_min"), F.lit(r.hi).alias("z_max"), F.lit(r.mean).alias("z_mean"), F.lit(relief).alias("relief"))


def strided_mean(df: DataFrame, step: int, value: str = "h") -> DataFrame:
    return df.where((F.col("i") % step == 0) & (F.col("j") % step == 0)).agg(F.avg(value).alias("mean"))


def coverage(df: DataFrame, value: str, above: float = 0.05) -> DataFrame:
    """Share of cells with a mask above a level."""
    return df.agg(F.avg((F.col(value) > above).cast("double")).alias("coverage"))


def field_difference(a: DataFrame, b: DataFrame, value: str = "h") -> DataFrame:
    """Largest absolute difference, root mean square, and that over the reference's range."""
    both = a.select("i", "j", F.col(value).alias("va")).join(b.select("i", "j", F.col(value).alias("vb")), ["i", "j"])
    d = F.col("va") - F.col("vb")
    out = both.agg(F.max(F.abs(d)).alias("max_abs"), F.sqrt(F.avg(d * d)).alias("rmse"), (F.max("vb") - F.min("vb")).alias("range"))
    return out.select("max_abs", "rmse", (F.col("rmse") / F.greatest("range", F.lit(1e-6))).alias("normalised_rmse"))


def normalised(df: DataFrame, value: str) -> DataFrame:
    """value over its largest, clamped."""
    top = max(df.agg(F.max(value)).first()[0] or 0.0, 1e-6)
    return df.withColumn(value, clamp(F.col(value) / top))


def squeeze(df: DataFrame, amount: float) -> DataFrame:
    """Draws heights toward the middle of their range."""
    lo, _, size = _range(df)
    t = min(max(amount / (amount + 8.0) if amount > 1 else amount, 0.0), 1.0)
    c = (clamp((F.col("h") - lo) / size) - 0.5) * 2.0
    s = 0.5 + 0.5 * F.when(c < 0, -1.0).otherwise(1.0) * F.pow(F.abs(c), F.lit(1.0 + t * 2.5))
    return df.withColumn("h", F.col("h") * (1.0 - t) + (F.lit(lo) + s * size) * t)


def curve(df: DataFrame, amount: float) -> DataFrame:
    """Gamma below 0.5, S-curve above, over the field's range."""
    lo, _, size = _range(df)
    a = min(max(amount, 0.0), 1.0)
    n = clamp((F.col("h") - lo) / size)
    if a < 0.5:
        shaped = F.pow(n, F.lit(1.0 + (0.5 - a) * 2.0))
    else:
        t = F.pow(n, F.lit(1.0 / max(1.0 + (a - 0.5) * 1.5, 0.35)))
        k = (a - 0.5) * 2.0
        shaped = n * (1.0 - k) + t * t * (3.0 - 2.0 * t) * k
    return df.withColumn("h", F.lit(lo) + clamp(shaped) * size)


def cutoff(df: DataFrame, level: float, amount: float) -> DataFrame:
    """A soft shelf: heights below a share of the range rise to it."""
    lo, _, size = _range(df)
    cut = lo + min(max(level, 0.0), 1.0) * size
    soft = max(min(max(amount, 0.0), 1.0) * size * 0.15, 1e-4)
    t = clamp((F.col("h") - (cut - soft)) / (2.0 * soft))
    return df.withColumn("h", cut * (1.0 - t) + F.col("h") * t)


def _margin(m: Metrics, amount: float) -> float:
    return amount if amount > 1 else max(min(max(amount, 0.02), 0.45) * min(m.world_x, m.world_z), m.dx)


def _to_edge(m: Metrics):
    i, j = F.col("i"), F.col("j")
    return F.least(i * m.dx, (m.width - 1 - i) * m.dx, j * m.dz, (m.height - 1 - j) * m.dz)


def zero_edge(df: DataFrame, m: Metrics, amount: float, base: float = 0.0) -> DataFrame:
    """Falls to base, or to the field's minimum where base is 0, toward the edge."""
    base = base if abs(base) > 1e-4 else _range(df)[0]
    t = smoothstep(0.0, _margin(m, amount), _to_edge(m))
    return df.withColumn("h", base * (1.0 - t) + F.col("h") * t)


def border_blend(df: DataFrame, m: Metrics, amount: float, rim: int, target: float = 0.0) -> DataFrame:
    """Blends to target, or to the mean of the rim where target is 0, toward the edge."""
    rim = max(1, rim)
    if abs(target) <= 1e-3:
        i, j = F.col("i"), F.col("j")
        at_rim = (i < rim) | (j < rim) | (i + rim >= m.width) | (j + rim >= m.height)
        target = df.where(at_rim).agg(F.avg("h")).first()[0] or 0.0
    b = 1.0 - smoothstep(0.0, _margin(m, amount), _to_edge(m))
    return df.withColumn("h", F.col("h") * (1.0 - b) + F.lit(target) * b)


def soften(df: DataFrame, hardness: str, deposit: str, softness: float) -> DataFrame:
    """hardness lowered where the deposit is a large share of its largest."""
    soft = min(max(softness, 0.0), 1.0)
    if soft <= 1e-6:
        return df
    top = max(df.agg(F.max(deposit)).first()[0] or 0.0, 1e-6)
    return df.withColumn(hardness, clamp(F.col(hardness) * (1.0 - soft * clamp(F.col(deposit) / top))))


def mark_deposits(df: DataFrame, material: str, deposit: str, softness: float, mark: float) -> DataFrame:
    """material set to mark where the deposit's share of its largest, times softness, exceeds a fifth."""
    soft = min(max(softness, 0.0), 1.0)
    if soft <= 1e-6:
        return df
    top = max(df.agg(F.max(deposit)).first()[0] or 0.0, 1e-6)
    return df.withColumn(material, F.when(clamp(F.col(deposit) / top) * soft > 0.2, mark).otherwise(F.col(material)))
