"""Climate fields of a grid and the biomes and plants that they allow."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.math import clamp, col
from ..sources.grid import Metrics
from ..sources.scratch import persisted
from .hydrology import seed_distance
from .stencil import central, degrees, slope_mask

#: The climate fields, each in [0, 1].
FIELDS = ("temperature", "rainfall", "humidity", "aridity", "snow", "soil_moisture", "wind_exposure")


@dataclass(frozen=True)
class Climate:
    """Controls of a climate; heights and distances in metres. The defaults are fixed values."""

    sea_level_temp: float = 0.72
    lapse_rate: float = 0.0012
    latitude: float = 0.35
    temp_gradient: float = 0.18
    wind_dir_deg: float = 90.0
    base_precip: float = 0.55
    base_humidity: float = 0.4
    orographic: float = 0.85
    rain_shadow: float = 0.7
    from_wetness: float = 0.35
    sea_level: float = 15.0
    water_influence: float = 120.0
    snow_temp: float = 0.28
    snow_line: float = 180.0


def bake(df: DataFrame, m: Metrics, c: Climate = Climate(), wetness: str | None = None, sediment: str | None = None) -> DataFrame:
    """The columns of df with temperature, rainfall, humidity, aridity, snow, soil_moisture and wind_exposure.

    Warmth falls with latitude, height and a gradient along j, and with slopes
    away from the sun; moisture comes from cells at sea level, by distance, and
    from the fields wetness and sediment; slopes into the wind gain rain and
    those behind them lose it. One distance transform and two windows.
    """
    wind = math.radians(c.wind_dir_deg)
    sea = seed_distance(df.select("i", "j", (F.col("h") <= c.sea_level).cast("double").alias("__sea")), m, "__sea").select("i", "j", F.col("distance").alias("__far"))
    d = central(df, m).join(persisted(sea), ["i", "j"])
    wet, sed = col(wetness) if wetness else F.lit(0.0), col(sediment) if sediment else F.lit(0.0)
    gx, gz, h = F.col("gx"), F.col("gz"), F.col("h")
    away = F.abs(F.pmod(F.degrees(F.atan2(gz, -gx)), F.lit(360.0)) - 180.0)
    north = (F.col("j") / max(m.height - 1, 1) - 0.5) * 2.0 if m.height > 1 else F.lit(0.0)
    d = d.withColumns({
        "__slope": clamp(degrees(gx, gz) / 90.0),
        "__warm": clamp(1.0 - away / 180.0),
        "__base": clamp(c.sea_level_temp - abs(c.latitude) * 0.35 - north * c.temp_gradient - c.lapse_rate * F.greatest(h, F.lit(0.0))),
        "__up": clamp(F.greatest(gx * math.sin(wind) + gz * math.cos(wind), F.lit(0.0)) * 2.0),
        "__lee": clamp(F.greatest(-(gx * math.sin(wind) + gz * math.cos(wind)), F.lit(0.0)) * 2.0),
        "__damp": clamp(c.base_humidity * 0.35 + clamp(F.exp(-F.col("__far") * max(math.hypot(m.world_x, m.world_z), 1.0) / max(c.water_influence, 1.0))) * 0.45 + wet * c.from_wetness + sed * 0.1),
    })
    base, slope = F.col("__base"), F.col("__slope")
    sun = (1.0 - slope * 0.35) * (0.65 + 0.35 * F.col("__warm"))
    d = d.withColumns({
        "temperature": clamp(base * 0.85 + sun * 0.15 * F.greatest(base, F.lit(0.15))),
        "rainfall": clamp(c.base_precip * F.col("__damp") * (1.0 + c.orographic * F.col("__up")) * F.greatest(1.0 - c.rain_shadow * F.col("__lee"), F.lit(0.05))),
        "wind_exposure": clamp(F.col("__up") * (0.4 + 0.6 * slope)),
    })
    cold = F.greatest(c.snow_temp - F.col("temperature"), F.lit(0.0)) / max(c.snow_temp, 1e-3)
    high = F.when(h >= c.snow_line, clamp((h - c.snow_line) / (max(c.snow_line, 1.0) * 0.5 + 1.0))).otherwise(0.0)
    d = d.withColumns({
        "humidity": clamp(F.col("__damp") * 0.55 + F.col("rainfall") * 0.45),
        "snow": clamp(F.greatest(cold, high) * (0.4 + 0.6 * F.col("rainfall"))),
        "soil_moisture": clamp(F.col("rainfall") * 0.45 + wet * 0.4 + sed * 0.15 - slope * 0.55),
    }).withColumn("aridity", clamp(1.0 - F.col("humidity")))
    return d.select(*df.columns, *FIELDS)


def without_climate(df: DataFrame, wetness: str | None = None) -> DataFrame:
    """The fields where no climate is asked for: soil holds the wetness, aridity is even, the rest is 0."""
    return df.withColumns({f: F.lit(0.5) if f == "aridity" else col(wetness) if f == "soil_moisture" and wetness else F.lit(0.0) for f in FIELDS})


def biomes(df: DataFrame, bands: Sequence[tuple[int, dict[str, tuple[float, float]]]]) -> DataFrame:
    """biome: the id, over 16, of the last band all of whose column ranges (ends included) hold; 0 for none."""
    found = F.lit(0.0)
    for number, ranges in bands:
        ok = F.lit(True)
        for c, (low, high) in ranges.items():
            ok = ok & F.col(c).between(low, high)
        found = F.when(ok, number / 16.0).otherwise(found)
    return df.withColumn("biome", found)


def plant_suitability(df: DataFrame, m: Metrics, min_slope: float, max_slope: float, biome: int | None = None, cover: str | None = None) -> DataFrame:
    """suitability: cover (1 without one) where the slope, and the biome if one is named, allow plants."""
    d = slope_mask(df, m)
    ok = (F.col("slope") * 90.0).between(min_slope, max_slope)
    if biome is not None:
        ok = ok & (F.round(F.col("biome") * 16.0) == biome)
    return d.withColumn("suitability", F.when(ok, clamp(col(cover)) if cover else F.lit(1.0)).otherwise(0.0)).select(*df.columns, "suitability")
