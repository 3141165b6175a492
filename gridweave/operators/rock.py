"""Rock: ridges and cliffs by likelihood, bedded strata, fractures, and the erosion that they steer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.math import clamp as cclamp
from ..functions.math import mix, smooth01
from ..functions.noise import Fractal
from ..functions.program import Program, clamp, num, run
from ..sources.grid import Metrics, with_world
from . import derivatives, stencil
from .effects import _soft_flows, gabor, unit_gradient
from .filters import FILTERS, Options, slope_gate


def ridge_valley(df: DataFrame, m: Metrics, radius_m: float) -> DataFrame:
    """ridge and valley: divergence and convergence of the plan curvature, weighted by slope."""
    r = max(1, round(radius_m / max(m.dx, 1e-6)))
    d = derivatives.slope(df, m, r).withColumnRenamed("slope", "__s").drop("aspect")
    d = derivatives.signed(derivatives.raw_curvatures(d, m, r), "raw_plan", "__c")
    c, s = F.col("__c"), F.col("__s")
    made = {"ridge": cclamp(F.greatest(c - 0.5, F.lit(0.0)) * 2.0 * (0.35 + 0.65 * s)), "valley": cclamp(F.greatest(0.5 - c, F.lit(0.0)) * 2.0 * (1.0 - 0.4 * s))}
    return d.withColumns(made).select(*df.columns, *made)


def cliffs(df: DataFrame, m: Metrics, radius: int, relief: float, slope_min: float) -> DataFrame:
    """cliff: relief of a disk, slope and profile curvature, over their field's largest, past a soft threshold."""
    r = max(1, radius)
    d = stencil.disk_extreme(stencil.disk_extreme(df, m, r, "max", "h", "__top"), m, r, "min", "h", "__low")
    d = derivatives.slope(d, m, r).withColumnRenamed("slope", "__s").drop("aspect")
    d = derivatives.signed(derivatives.raw_curvatures(d, m, r), "raw_profile", "__c")
    tall = cclamp((F.col("__top") - F.col("__low")) / (max(relief, 1e-3) * max(m.dx, 1.0) * r * 4.0))
    steep = cclamp((F.col("__s") * 90.0 - slope_min) / max(90.0 - slope_min, 1.0))
    d = d.withColumn("__k", tall * 0.45 + steep * 0.40 + cclamp(F.abs(F.col("__c") - 0.5) * 2.0) * 0.15).select(*df.columns, "__k")
    most = max(d.agg(F.max("__k")).first()[0] or 0.0, 1e-6)
    return d.withColumn("cliff", smooth01((F.col("__k") / most - 0.25) / 0.55)).drop("__k")


def bed_warp(p: Program, name: str, geometry: tuple) -> Program:
    """Binds name: how far beds lie off the horizontal, in metres. geometry is ("horizontal",), ("tilted", dip, azimuth in degrees), ("folded", metres, wavelength, seed) or ("warped", frequency, metres, seed)."""
    kind, *v = geometry
    if kind == "tilted":
        dip, az = (math.radians(a) for a in v)
        return p.let(**{name: f"(x * {num(math.cos(az))} + z * {num(math.sin(az))}) * {num(math.sin(dip))}"})
    if kind == "folded":
        size, wave = v[0], max(v[1], 1.0)
        p.sample("perlin", **{f"{name}_n": (f"x / {num(wave)}", f"z / {num(wave)}", v[2])})
        return p.let(**{name: f"sin(x / {num(wave)} * {num(math.tau)}) * {num(size)} + {name}_n * {num(size * 0.35)}"})
    if kind == "warped":
        f = max(v[0], 1e-5)
        p.sample("perlin", **{f"{name}_n": (f"x * {num(f)}", f"z * {num(f)}", v[2])})
        return p.let(**{name: f"{name}_n * {num(v[1])}"})
    return p.let(**{name: "0.0"})


def beds(frequency: float, contrast: float, geometry: tuple, p: Program | None = None) -> Program:
    """Binds strat, hardness, erodibility and layer of the bed at (x, z, h); lo is the grid's lowest height."""
    k = min(max(contrast, 0.0), 1.0)
    p = bed_warp(p or Program(), "warp", geometry)
    p.let(strat="h + warp", phase=f"floor((strat - lo) * {num(max(frequency, 1e-5) * 2.5)})", lay="phase - floor(phase / 6.0) * 6.0", bed0="lay * 0.17 + warp * 0.02", bed="case when bed0 >= 0.0 then bed0 - floor(bed0) else bed0 + floor(-bed0) end")
    p.let(hardness=f"case when bed < 0.45 then {num(min(0.55 + k * 0.4, 0.98))} when bed < 0.75 then {num(0.35 + k * 0.15)} else {num(max(0.12 + (1.0 - k) * 0.2, 0.05))} end")
    return p.let(erodibility=clamp("1.0 - hardness", 0.02, 0.98), layer=clamp("lay / 5.0"))


def with_beds(df: DataFrame, m: Metrics, frequency: float, contrast: float, geometry: tuple) -> DataFrame:
    """hardness and layer of each cell's bed; geometry as in bed_warp."""
    lo = df.agg(F.min("h")).first()[0] or 0.0
    return run(with_world(df, m).withColumn("lo", F.lit(lo)), beds(frequency, contrast, geometry), "hardness", "layer").drop("x", "z", "lo")


def rock_beds(frequency: float, contrast: float, seed: int) -> tuple:
    """The warped beds that rocky filters share."""
    return ("warped", max(frequency, 1e-5) * 0.35, 12.0 + contrast * 20.0, seed ^ 0x57A7A)


def expose(df: DataFrame, amount: float, face: str) -> DataFrame:
    """Soft beds recede on faces; the harder of them leave a small ledge. Reads hardness."""
    soft, amt = 1.0 - F.col("hardness"), max(amount, 0.0)
    change = soft * amt * F.col(face) * (F.when(soft < 0.35, 0.15).otherwise(0.0) - 1.0)
    return df.withColumn("h", F.when(F.col(face) < 1e-4, F.col("h")).otherwise(F.col("h") + change))


def band_program(frequency: float, amount: float, seed: int) -> Program:
    """Binds out: h moved by its bed's hardness, with a fine wave along the beds; reads lo."""
    f, a = max(frequency, 1e-5), max(amount, 0.0)
    p = beds(f, 0.7, ("folded", a * 0.35, min(max(1.0 / f, 8.0), 400.0), seed))
    fine = f" + (sin(strat * {num(f)}) * 0.5 + 0.5) * {num(a * 0.35)} - {num(a * 0.175)}" if a > 1e-4 else ""
    return p.let(out=f"h + (hardness - 0.5) * 2.0 * {num(a * 0.5)}{fine}")


def fracture_program(frequency: float, seed: int, scales: int, p: Program | None = None) -> Program:
    """Binds frac: Gabor noise and cell cracks at several scales, about -1 to 1."""
    p, a, weight, total = p or Program(), 1.0, 0.0, []
    for k in range(min(max(scales, 1), 4)):
        f = max(frequency, 1e-5) * 1.7**k
        gabor(p, f"fg{k}", "x", "z", f, seed ^ ((k + 1) * 0x9E37))
        p.sample("worley", **{f"fc{k}": (f"x * {num(f)}", f"z * {num(f)}", seed + 17 * k)})
        total.append(f"(fg{k} * 0.55 + {clamp(f'(fc{k}2 - fc{k}1) * 2.0 - 0.5', -1.0, 1.0)} * 0.45) * {num(a)}")
        weight += a
        a *= 0.55
    return p.let(frac=f"({' + '.join(total)}) / {num(weight)}")


def lithology_program(rock_hardness: float, frequency: float, seed: int, p: Program | None = None) -> Program:
    """Binds hardness: hard cores and softer surrounds."""
    base, f = min(max(rock_hardness, 0.05), 0.98), max(frequency, 1e-5)
    p = (p or Program()).sample("perlin", ln=(f"x * {num(f)}", f"z * {num(f)}", seed))
    return p.let(hardness=clamp(f"{num(base)} + (ln - 0.5) * {num((1.0 - base) * 0.55)}", 0.05, 0.98))


def ridge_program(amount: float, slope_min: float, slope_max: float, frequency: float, seed: int, wide: bool) -> Program:
    """Binds out: ridged noise along each cell's gradient, by slope and ridge; reads slope, gx, gz and ridge."""
    lo, hi = min(slope_min, slope_max), max(slope_min, slope_max)
    p = Program().let(g="1.0" if hi <= lo + 1e-3 else clamp(f"(slope - {num(lo)}) / {num(hi - lo)}"), flat="case when gx = 0.0 and gz = 0.0 then 1.0 else 0.0 end", ax="case when flat > 0.5 then x else x * gx - z * gz end", az="case when flat > 0.5 then z else x * gz + z * gx end")
    p.ridged("rn", "ax", "az", Fractal(seed=seed, frequency=max(frequency, 1e-5) * (0.35 if wide else 1.0), amplitude=1.0, octaves=3 if wide else 4))
    return p.let(out=f"case when g < 1e-4 then h else h + (rn * 2.0 - 1.0) * {num(amount * (0.65 if wide else 1.0))} * g * (0.35 + ridge * 0.65) end")


def enhance_ridges(df: DataFrame, m: Metrics, amount: float, slope_min: float, slope_max: float, frequency: float, seed: int, wide: bool = False) -> DataFrame:
    """Ridge-aware sharpening of divides."""
    d = unit_gradient(ridge_valley(df, m, 48.0 if wide else 12.0), m)
    return run(with_world(d, m), ridge_program(amount, slope_min, slope_max, frequency, seed, wide), "out").withColumn("h", F.col("out")).select(*df.columns)


def differential_erode(df: DataFrame, m: Metrics, amount: float, iterations: int, protect: bool = True, radius_m: float = 16.0) -> DataFrame:
    """Soft cells sink toward their neighbourhood's mean, ridges less; reads hardness."""
    n = min(max(iterations, 1), 8)
    d = ridge_valley(df, m, radius_m) if protect else df.withColumn("ridge", F.lit(0.0))
    strip = (1.0 - F.col("hardness")) * (1.0 - F.col("ridge") * 0.85) * (amount / n)
    for _ in range(n):
        d = stencil.shrinking_mean(d.withColumn("__m", F.col("h")), 1, 1, "__m")
        h = F.col("h")
        d = d.withColumn("h", F.when(strip < 1e-5, h).otherwise(h + (F.least(h, F.col("__m")) - h) * cclamp(strip))).drop("__m")
    return d.select(*df.columns)


def _hard(df: DataFrame, m: Metrics, o: Options, least: float, frequency: float, seed: int | None = None) -> DataFrame:
    p = lithology_program(max(o.extra.get("rock_hardness", 0.5), least), frequency, o.seed if seed is None else seed)
    return run(with_world(df, m), p, "hardness").drop("x", "z")


def _rocky_sharp(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    d = stencil_written(enhance_ridges(df, m, o.amount, o.slope_min, o.slope_max, o.frequency, o.seed))
    return differential_erode(_hard(d, m, o, 0.45, o.frequency), m, o.amount * 0.12, 1).select(*df.columns)


def _rocky_wide(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    d = stencil_written(enhance_ridges(df, m, o.amount, o.slope_min, o.slope_max, max(o.frequency, 0.004), o.seed, True))
    return differential_erode(_hard(d, m, o, 0.4, o.frequency * 0.35), m, o.amount * 0.18, 2).select(*df.columns)


def stencil_written(df: DataFrame) -> DataFrame:
    """Written once: several global reductions read it."""
    from ..sources.scratch import persisted

    return persisted(df)


def _rocky_layers(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    hard = o.extra.get("rock_hardness", 0.5)
    f = max(o.frequency, 0.01)
    d = with_beds(cliffs(df, m, max(o.radius, 1) + 1, 0.12, max(o.slope_min, 12.0)), m, f, hard, rock_beds(f, hard, o.seed))
    d = stencil.extreme(stencil_written(expose(d, o.amount * 0.55, "cliff")), 1, "max", out="__top")
    up = F.least(F.col("__top") - F.col("h"), F.lit(o.amount * 0.2)) * F.col("hardness") * F.col("cliff")
    return d.withColumn("h", F.col("h") + F.when((F.col("cliff") >= 0.05) & (F.col("hardness") >= 0.5), up).otherwise(0.0)).select(*df.columns)


def _chipped(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    """Chips broken from faces and ridges where the fracture field is high."""
    d = cliffs(ridge_valley(df, m, 12.0), m, max(o.radius, 1) + 1, max(o.extra.get("flow_threshold", 0.2), 0.08), o.slope_min)
    d = stencil.slope_forward(_hard(d, m, o, 0.0, max(o.frequency, 0.02)), m)
    d = run(with_world(d, m), fracture_program(max(o.frequency, 0.04), o.seed ^ 0xC11F, 3), "frac")
    drive = F.greatest(F.col("cliff"), F.col("ridge") * 0.65) * slope_gate(F.col("slope"), o)
    chip = F.when(F.col("frac") > 0.12, (F.col("frac") - 0.12) * o.amount * (0.55 + (1.0 - F.col("hardness")) * 0.9)).otherwise(0.0)
    return d.withColumn("h", F.col("h") - F.when(drive < 1e-4, 0.0).otherwise(chip * drive)).select(*df.columns)


def _rocky(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    flows = stencil_written(_soft_flows(df, m, o))
    rock = _rocky_sharp(flows, m, o).select("i", "j", F.col("h").alias("__r"))
    return flows.join(rock, ["i", "j"]).withColumn("h", mix(F.col("h"), F.col("__r"), 0.55)).select(*df.columns)


def _strata(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    """Ledges by bed, and soft beds recessed on steep faces."""
    f = max(o.frequency, 1e-5)
    lo = df.agg(F.min("h")).first()[0] or 0.0
    d = run(with_world(df, m).withColumn("lo", F.lit(lo)), band_program(f, o.amount, o.seed), "out").withColumn("h", F.col("out")).select(*df.columns)
    d = stencil_written(d)
    d = with_beds(stencil.slope_forward(d, m), m, f, min(max(o.extra.get("rock_hardness", 0.5), 0.15), 0.95), ("folded", max(o.amount, 0.0) * 0.4, min(max(1.0 / f, 8.0), 400.0), o.seed))
    return expose(d.withColumn("__face", slope_gate(F.col("slope"), o)), o.amount * 0.45, "__face").select(*df.columns)


FILTERS.update({"rocky_sharp": _rocky_sharp, "rocky_wide": _rocky_wide, "rocky_layers": _rocky_layers, "chipped": _chipped, "rocky": _rocky, "strata": _strata})
