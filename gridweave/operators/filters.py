"""Effect filters by name: each changes a grid's heights, then strength and invert blend the change in."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import noise
from ..functions.math import clamp, fade, mix, nearest_int
from ..sources.grid import Metrics, with_world
from . import combine, hydrology, pointwise, reduce, stencil


@dataclass(frozen=True)
class Options:
    """What a filter may read; the meaning of amount, radius and level is the filter's."""

    amount: float = 1.0
    radius: int = 1
    iterations: int = 1
    frequency: float = 0.02
    seed: int = 1
    octaves: int = 3
    lacunarity: float = 2.0
    persistence: float = 0.5
    level: float = 0.0
    slope_min: float = 0.0
    slope_max: float = 90.0
    rotation_deg: float = 0.0
    anisotropy: float = 1.0
    strength: float = 1.0
    invert: bool = False
    extra: dict = field(default_factory=dict)

    @property
    def fractal(self) -> noise.Fractal:
        return noise.Fractal(seed=self.seed, frequency=max(self.frequency, 1e-5), amplitude=1.0, octaves=max(1, self.octaves), lacunarity=max(self.lacunarity, 1.01), persistence=min(max(self.persistence, 0.05), 0.95))


def slope_gate(slope: Column, o: Options) -> Column:
    lo, hi = min(o.slope_min, o.slope_max), max(o.slope_min, o.slope_max)
    return F.lit(1.0) if hi <= lo + 1e-3 else clamp((slope - lo) / (hi - lo))


def _added(sample: Callable[[noise.Let, Column, Column, Options], Column]):
    """A filter that adds amount times a noise sample at each cell's centre."""

    def run(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
        let = noise.Let(with_world(df, m))
        n = sample(let, F.col("x"), F.col("z"), o)
        return let.done(h=F.col("h") + n * o.amount).select(*df.columns)

    return run


def _billow(let, x, z, o):
    p = o.fractal
    total = sum(F.abs(n) * a for n, (_, a) in zip(noise.perlin(let, p.samples(x, z, 1301)), p.levels(), strict=True))
    return total / sum(a for _, a in p.levels()) * 2.0 - 1.0


def _cells(let, x, z, o):
    return clamp(noise.cell_feature(let, x, z, o.fractal, o.extra.get("feature", "f1")) * 2.0 - 1.0, -1.0, 1.0)


def _design_cells(let, x, z, o):
    f1, f2 = noise.worley(let, x * o.frequency, z * o.frequency, o.seed)
    return {"f1": 1.0 - clamp(f1), "f2": 1.0 - clamp(f2, 0.0, 1.2) / 1.2, "f2-f1": clamp(f2 - f1)}[o.extra.get("feature", "f1")]


def _wave(let, x, z, o):
    a = max(o.anisotropy, 0.05)
    return clamp(F.sin(x * o.frequency / a) * F.cos(z * o.frequency * 0.7 * math.sqrt(a)), -1.0, 1.0)


def _white(let, x, z, o):
    (h,) = noise.lattice_hash(let, [(F.col("i"), F.col("j"), noise.seed32(o.seed))])
    return noise.unit(h) * 2.0 - 1.0


def terraced(h: Column, lo: float, size: float, levels: int, offset: float = 0.0, top: float = 0.15, sharp: float = 0.75, weight: Column | float = 1.0) -> Column:
    """Bands over a range: a flat tread, then a riser that is narrow where sharp is near 1; top eases treads back to the source."""
    step = max(size / max(2, levels), 1e-4)
    riser = min(max(1.0 - min(max(sharp, 0.0), 1.0), 0.04), 0.92)
    tread = 1.0 - riser
    phase = offset % 1.0
    t = (h - lo) / step + phase
    band = F.floor(t).cast("double")
    part = t - band
    climbed = F.when(part <= tread, band).otherwise(band + fade(clamp((part - tread) / riser)))
    out = F.lit(lo) + (climbed - phase) * step
    if top > 1e-4:
        edge = F.when(part <= tread, clamp((tread - part) / max(tread, 1e-4))).otherwise(0.0)
        out = mix(out, h, (1.0 - fade(edge)) * min(top, 1.0) * 0.65)
    out = clamp(out, lo, lo + size)
    return mix(h, out, weight) if isinstance(weight, Column) else out


def _terrace(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    lo, hi = df.agg(F.min("h"), F.max("h")).first()
    return df.withColumn("h", terraced(F.col("h"), lo, max(hi - lo, 1e-5), max(2, round(o.amount)), o.level, o.extra.get("top", 0.15), o.extra.get("sharp", 0.75)))


def _balloon(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    d = stencil.slope_forward(stencil.extreme(df, o.radius, "max", out="__top"), m)
    up = F.col("h") + F.least(F.col("__top") - F.col("h"), F.lit(o.amount))
    return d.withColumn("h", mix(F.col("h"), up, slope_gate(F.col("slope"), o))).select(*df.columns)


def _extreme(pick: str):
    def run(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
        h, e = F.col("h"), F.col("__near")
        gap = F.least(e - h if pick == "max" else h - e, F.lit(o.amount))
        return stencil.extreme(df, o.radius, pick, out="__near").withColumn("h", h + gap if pick == "max" else h - gap).select(*df.columns)

    return run


def _smooth(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    for _ in range(max(1, o.iterations)):
        df = stencil.box_mean(df, m, o.radius)
    return df


def _hexagons(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    """Blends toward the height at the centre of a hexagonal cell."""
    size = max(1.0 / max(o.frequency, 1e-5), 2.0)
    d = with_world(df, m)
    q = nearest_int(F.col("x") * (2.0 / 3.0) / size)
    r = nearest_int((-F.col("x") / 3.0 + math.sqrt(3.0) / 3.0 * F.col("z")) / size)
    u, v = clamp(size * 1.5 * q / m.world_x), clamp(size * (math.sqrt(3.0) / 2.0 * q + math.sqrt(3.0) * r) / m.world_z)
    got = combine.gather(d.select("i", "j", "h", "x", "z"), nearest_int(u * (m.width - 1)), nearest_int(v * (m.height - 1)), m)
    t = min(max(o.amount / (o.amount + 4.0), 0.2), 0.9)
    return df.join(got.select("i", "j", F.col("h").alias("__c")), ["i", "j"]).withColumn("h", mix(F.col("h"), F.col("__c"), t)).select(*df.columns)


def _washed(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    """Lowers and smooths steep cells that gather little flow."""
    d = hydrology.multi_flow(df, m, 4)
    top = max(d.agg(F.max("flow")).first()[0] or 0.0, 1e-6)
    d = stencil.box_mean(stencil.slope_forward(d, m), m, o.radius, out="__b")
    bare = clamp(clamp((F.col("slope") - o.slope_min) / max(90.0 - o.slope_min, 1.0)) * (1.0 - clamp(F.col("flow") / top)))
    return d.withColumn("h", mix(F.col("h"), F.col("__b"), bare * 0.7) - bare * (o.amount * 0.4)).select(*df.columns)


FILTERS: dict[str, Callable[[DataFrame, Metrics, Options], DataFrame]] = {
    "smooth": _smooth,
    "spike_removal": lambda df, m, o: stencil.despike(df, m, o.radius, o.amount),
    "shore": lambda df, m, o: df.withColumn("h", pointwise.coastal(F.col("h"), o.level, o.amount, o.extra.get("shelf", 0.0))),
    "denoise": lambda df, m, o: stencil.bilateral(df, m, o.radius, max(1, o.radius) * 0.5, max(o.amount, 0.5)),
    "inflate": _extreme("max"),
    "deflate": _extreme("min"),
    "balloon": _balloon,
    "blocks": lambda df, m, o: df.withColumn("h", pointwise.blocks(F.col("h"), o.amount)),
    "directional_blur": lambda df, m, o: stencil.directional_mean(df, m, o.radius, math.cos(math.radians(o.rotation_deg)), math.sin(math.radians(o.rotation_deg))),
    "squeeze": lambda df, m, o: reduce.squeeze(df, o.amount),
    "washed_off": _washed,
    "hexagons": _hexagons,
    "zero_edge": lambda df, m, o: reduce.zero_edge(df, m, o.amount, o.level),
    "border_blend": lambda df, m, o: reduce.border_blend(df, m, o.amount, o.radius, o.level),
    "curve": lambda df, m, o: reduce.curve(df, o.amount),
    "cutoff": lambda df, m, o: reduce.cutoff(df, o.level, o.amount),
    "terrace_simple": _terrace,
    "add_set": lambda df, m, o: df.withColumn("h", F.lit(o.amount) if o.level >= 0.5 else F.col("h") + o.amount),
    "talus": lambda df, m, o: hydrology.thermal(df, m, o.extra.get("repose", 32.0), o.amount, o.iterations),
    "design_voronoi": _added(_design_cells),
    "noise_billow": _added(_billow),
    "noise_perlin": _added(lambda let, x, z, o: noise.fbm(let, "perlin", x, z, o.fractal)),
    "noise_simplex": _added(lambda let, x, z, o: noise.fbm(let, "simplex", x, z, o.fractal)),
    "noise_value": _added(lambda let, x, z, o: noise.fbm(let, "value", x, z, o.fractal)),
    "noise_ridged": _added(lambda let, x, z, o: noise.ridged(let, "perlin", x, z, o.fractal) * 2.0 - 1.0),
    "noise_voronoi": _added(_cells),
    "noise_wave": _added(_wave),
    "noise_white": _added(_white),
}


def apply(df: DataFrame, m: Metrics, kind: str, o: Options) -> DataFrame:
    """The filter of that name over h, by strength; joined to its input only if a share of it is kept."""
    out = FILTERS[kind](df, m, o)
    if o.strength >= 1.0 and not o.invert:
        return out
    both = df.join(out.select("i", "j", F.col("h").alias("__f")), ["i", "j"])
    return both.withColumn("h", pointwise.with_strength(F.col("h"), F.col("__f"), o.strength, o.invert)).select(*df.columns)
