"""Synthetic grids with known answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Metrics


def radius(m: Metrics) -> Column:
    dx, dz = F.col("i") - (m.width - 1) / 2, F.col("j") - (m.height - 1) / 2
    return F.sqrt(dx * dx + dz * dz)


def plane(m: Metrics) -> Column:
    return (m.width - 1 - F.col("i")).cast("double")


def valley(m: Metrics) -> Column:
    return F.abs(F.col("i") - (m.width - 1) / 2) + (m.height - 1 - F.col("j")) * 0.15


def cone(m: Metrics) -> Column:
    reach = max(math.hypot((m.width - 1) / 2, (m.height - 1) / 2), 1.0)
    return F.greatest(F.lit(0.0), 1.0 - radius(m) / reach) * 50.0


def basin(m: Metrics) -> Column:
    return 2.0 * radius(m)


def two_basins(m: Metrics) -> Column:
    mid = m.width // 2
    off = F.abs(F.col("i") - mid)
    side = F.when(F.col("i") < mid, F.col("i") / max(mid, 1)).otherwise((F.col("i") - mid) / max(mid, 1))
    wall = F.when(off <= 1, 30.0).otherwise(0.0)
    return F.abs(side - 0.5) * 20.0 + wall + F.abs(F.col("j") - (m.height - 1) / 2) * 0.05 + (1.0 - off / max(mid, 1)) * 0.01


def pit(m: Metrics) -> Column:
    di, dj = F.abs(F.col("i") - m.width // 2), F.abs(F.col("j") - m.height // 2)
    return plane(m) - F.when((di <= 2) & (dj <= 2), 8.0).otherwise(0.0) - F.when((di == 0) & (dj == 0), 4.0).otherwise(0.0)


def all_of(cells: DataFrame, m: Metrics) -> DataFrame:
    return cells.select("i", "j", *(f(m).alias(f.__name__) for f in (plane, valley, cone, basin, two_basins, pit)))
