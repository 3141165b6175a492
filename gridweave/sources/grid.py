"""Grids as relations: one row for each cell, keyed by (i, j)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metrics:
    """Size of a grid in cells and metres; tile is the side of a tile in cells."""

    width: int
    height: int
    world_x: float
    world_z: float
    tile: int = 256
    halo: int = 2

    @property
    def dx(self) -> float:
        return self.world_x / self.width

    @property
    def dz(self) -> float:
        return self.world_z / self.height


def cells(spark: SparkSession, m: Metrics, partitions: int | None = None) -> DataFrame:
    """(i, j) of every cell, from a range that the cluster generates in place."""
    ids = spark.range(0, m.width * m.height, 1, partitions) if partitions else spark.range(m.width * m.height)
    return ids.select((F.col("id") % m.width).cast("int").alias("i"), F.expr(f"cast(id div {m.width} as int)").alias("j"))


def with_world(df: DataFrame, m: Metrics) -> DataFrame:
    """x and z of cell centres in metres."""
    return df.withColumns({"x": (F.col("i") + 0.5) * m.dx, "z": (F.col("j") + 0.5) * m.dz})


def with_tiles(df: DataFrame, m: Metrics) -> DataFrame:
    """tx and tz: the tile of each cell, the unit of storage and of recomputation."""
    return df.withColumns({"tx": F.expr(f"cast(i div {m.tile} as int)"), "tz": F.expr(f"cast(j div {m.tile} as int)")})


def only_tiles(df: DataFrame, tiles: DataFrame, m: Metrics) -> DataFrame:
    """The cells of the listed (tx, tz): any pointwise operator after this is tile-scoped."""
    return with_tiles(df, m).join(tiles.select("tx", "tz").distinct(), ["tx", "tz"], "left_semi").drop("tx", "tz")


def complete(values: DataFrame, m: Metrics, fill: float = 0.0, value: str = "h") -> DataFrame:
    """A dense grid from sparse (i, j, value) rows; cells without one hold fill."""
    return cells(values.sparkSession, m).join(values, ["i", "j"], "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def _ramp(m: Metrics, direction: float, lo: float, hi: float) -> Column:
    import math

    t = F.col("x") / m.world_x * math.cos(direction) + F.col("z") / m.world_z * math.sin(direction)
    return F.lit(lo) + F.lit(hi - lo) * F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))


def flat(df: DataFrame, height: float) -> DataFrame:
    return df.withColumn("h", F.lit(float(height)))


def ramp(df: DataFrame, m: Metrics, direction: float = 0.0, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """A linear slope along a direction in radians."""
    return with_world(df, m).withColumn("h", _ramp(m, direction, lo, hi)).drop("x", "z")
