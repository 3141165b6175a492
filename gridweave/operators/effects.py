"""Effect filters as field programs over a grid's own columns, with stencils and gathers where a filter needs neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import clamp as cclamp
from ..functions.math import nearest_int
from ..functions.noise import Fractal
from ..functions.program import Program, clamp, num, quintic, run
from ..sources.grid import Metrics, with_world
from . import combine, hydrology, stencil
from .filters import FILTERS, Options


def oriented(p: Program, x: str, z: str, rotation_deg: float, anisotropy: float, names: tuple[str, str]) -> Program:
    """Coordinates turned and stretched along a direction."""
    a, c, s = max(anisotropy, 0.05), math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))
    return p.let(**{names[0]: f"({x} * {num(c)} + {z} * {num(s)}) / {num(a)}", names[1]: f"({x} * {num(-s)} + {z} * {num(c)}) * {num(max(math.sqrt(a), 0.2))}"})


#: Seeds of an impulse's place, orientation, frequency, phase and weight. Fixed values.
IMPULSE = {"jx": 0xA11C, "jz": 0xB22D, "th": 0xC33E, "fm": 0xD44F, "ph": 0xE55A, "am": 0xF66B}
_UNIT = "/ 4294967295.0"


def gabor(p: Program, name: str, x: str, z: str, frequency: float, seed: int) -> Program:
    """Binds name: cosine impulses of the 3 by 3 cells around, one for each cell, over their envelopes' sum."""
    f = max(frequency, 1e-5)
    cell = 1.0 / f
    p.let(**{f"{name}_ix": f"floor({x} / {num(cell)})", f"{name}_iz": f"floor({z} / {num(cell)})"})
    at = [(a, b) for b in (-1, 0, 1) for a in (-1, 0, 1)]
    p.sample("hash", **{f"{name}_{k}{n}": (f"{name}_ix + {a}", f"{name}_iz + {b}", (seed & 0xFFFFFFFF) ^ key) for n, (a, b) in enumerate(at) for k, key in IMPULSE.items()})
    top, low = [], []
    for n, (a, b) in enumerate(at):
        u = lambda k, n=n: f"({name}_{k}{n} {_UNIT})"
        e, dx, dz = f"{name}_e{n}", f"{name}_dx{n}", f"{name}_dz{n}"
        p.let(**{dx: f"{x} - ({name}_ix + {num(a)} + {u('jx')}) * {num(cell)}", dz: f"{z} - ({name}_iz + {num(b)} + {u('jz')}) * {num(cell)}"})
        p.let(**{f"{e}r": f"exp(-({dx} * {dx} + {dz} * {dz}) / {num(2.0 * (cell * 0.45) ** 2)})", e: f"case when {e}r < 1e-5 then 0.0 else {e}r end"})
        wave = f"cos(({dx} * cos({u('th')} * {num(math.tau)}) + {dz} * sin({u('th')} * {num(math.tau)})) * {num(f)} * (0.85 + 0.3 * {u('fm')}) * {num(math.tau)} + {u('ph')} * {num(math.tau)})"
        top.append(f"{e} * {wave} * ({u('am')} * 2.0 - 1.0)")
        low.append(e)
    p.let(**{f"{name}_t": " + ".join(top), f"{name}_w": " + ".join(low)})
    return p.let(**{name: f"case when {name}_w < 1e-5 then 0.0 else {clamp(f'{name}_t / {name}_w', -1.0, 1.0)} end"})


def phasor(p: Program, name: str, x: str, z: str, frequency: float, seed: int) -> Program:
    """Binds name: the length of four waves of varying direction, contrasted to [-1, 1]."""
    f = max(frequency, 1e-5)
    s = [seed + 9173 * k for k in range(4)]
    p.sample("simplex", **{f"{name}_t{k}": (f"{x} * {num(f * 0.15)} + {num(3.1 * k)}", f"{z} * {num(f * 0.15)} - {num(1.7 * k)}", s[k]) for k in range(4)}, **{f"{name}_p{k}": (f"{x} * {num(f * 0.07)}", f"{z} * {num(f * 0.07)}", s[k] ^ 0x51AF) for k in range(4)})
    p.sample("value", **{f"{name}_a{k}": (f"{x} * {num(f * 0.2)}", f"{z} * {num(f * 0.2)}", s[k] ^ 0xC0DE) for k in range(4)})
    for k in range(4):
        p.let(**{f"{name}_q{k}": f"({x} * cos({name}_t{k} * {num(math.pi)}) + {z} * sin({name}_t{k} * {num(math.pi)})) * {num(f * math.tau)} + {name}_p{k} * {num(math.pi)}"})
    side = lambda g: " + ".join(f"(0.55 + 0.45 * abs({name}_a{k})) * {g}({name}_q{k})" for k in range(4))
    p.let(**{f"{name}_re": side("cos"), f"{name}_im": side("sin")})
    return p.let(**{name: clamp(f"tanh(sqrt({name}_re * {name}_re + {name}_im * {name}_im) * 1.15) * 2.0 - 1.0", -1.0, 1.0)})


def octaves(kernel, p: Program, name: str, x: str, z: str, o: Options, stride: int) -> Program:
    """Binds name: the kernel's octaves over their weights, in [-1, 1]."""
    a, f, total, weight = 1.0, max(o.frequency, 1e-5), [], 0.0
    for k in range(max(1, o.octaves)):
        oriented(p, x, z, o.rotation_deg, o.anisotropy, (f"{name}x{k}", f"{name}z{k}"))
        kernel(p, f"{name}k{k}", f"{name}x{k}", f"{name}z{k}", f, o.seed + stride * k)
        total.append(f"{name}k{k} * {num(a)}")
        weight += a
        a *= min(max(o.persistence, 0.05), 0.95)
        f *= max(o.lacunarity, 1.01)
    return p.let(**{name: clamp(f"({' + '.join(total)}) / {num(weight)}", -1.0, 1.0)})


def warped(p: Program, o: Options) -> Program:
    """wx, wz: world coordinates turned, stretched and, with a warp, shifted by gradient noise."""
    oriented(p, "x", "z", o.rotation_deg, o.anisotropy, ("tx", "tz"))
    w, f = o.extra.get("warp_strength", 0.0), max(o.extra.get("warp_frequency", 0.01), 1e-5)
    if abs(w) <= 1e-5:
        return p.let(wx="tx", wz="tz")
    p.sample("perlin", w1=(f"tx * {num(f)}", f"tz * {num(f)}", o.seed), w2=(f"tx * {num(f)} + 19.1", f"tz * {num(f)} + 7.3", o.seed + 1))
    return p.let(wx=f"tx + w1 * {num(w)}", wz=f"tz + w2 * {num(w)}")


# Programs of filters that read their own cell: h, x, z, and slope, gx, gz (a unit vector, 0 if flat) where named in NEEDS.


def gabor_noise(m: Metrics, o: Options) -> Program:
    return octaves(gabor, warped(Program(), o), "n", "wx", "wz", o, 7919).let(out=f"h + n * {num(o.amount)}")


def phasor_noise(m: Metrics, o: Options) -> Program:
    return octaves(phasor, warped(Program(), o), "n", "wx", "wz", o, 4243).let(out=f"h + n * {num(o.amount)}")


def ridged_detail(m: Metrics, o: Options) -> Program:
    p = Program().ridged("r", "x", "z", Fractal(seed=o.seed, frequency=max(o.frequency, 1e-5), amplitude=1.0, octaves=5, lacunarity=2.1, persistence=0.55))
    return p.let(out=f"h + (r * 2.0 - 1.0) * {num(o.amount)}")


def rugged(m: Metrics, o: Options) -> Program:
    f = Fractal(seed=o.seed ^ 0xA06D, frequency=max(o.frequency, 1e-5), amplitude=1.0, octaves=6, lacunarity=2.3, persistence=0.6)
    p = Program().fbm("n", "x", "z", f).ridged("r", "(x * 1.7)", "(z * 1.7)", f)
    return p.let(out=f"h + (n * 0.45 + (r * 2.0 - 1.0) * 0.55) * {num(o.amount)}")


def scatter_detail(m: Metrics, o: Options) -> Program:
    """About one cell in eight holds an impulse at a hashed place, of a hashed weight."""
    cell = max(1.0 / max(o.frequency, 1e-5), 2.0)
    p = warped(Program(), o).let(cx=f"floor(wx / {num(cell)})", cz=f"floor(wz / {num(cell)})").sample("hash", k=("cx", "cz", o.seed))
    byte = lambda n: f"(mod(floor(k / {num(2.0**n)}), 256) / 255.0)"
    p.let(ex=f"wx - (cx + {byte(8)}) * {num(cell)}", ez=f"wz - (cz + {byte(16)}) * {num(cell)}", e=f"exp(-(ex * ex + ez * ez) / {num(2.0 * (cell * 0.28) ** 2)})")
    return p.let(out=f"case when mod(k, 1000) > 120 or e < 1e-3 then h else h + ({byte(24)} * 2.0 - 1.0) * {num(o.amount)} * e end")


def crater(m: Metrics, o: Options) -> Program:
    """A bowl, a raised rim and a thin ejecta blanket around the middle, distorted by noise."""
    r = max(min(max(o.extra.get("crater_radius", 0.22), 0.02), 0.5) * min(m.world_x, m.world_z), m.dx * 2.0)
    depth, f = max(o.amount, 0.0), max(o.frequency, 1e-5) * 2.5
    p = warped(Program(), o).sample("perlin", n=(f"wx * {num(f)}", f"wz * {num(f)}", o.seed ^ 0xC2A7))
    p.let(d=f"greatest(sqrt(pow(x - {num(m.world_x * 0.5)}, 2.0) + pow(z - {num(m.world_z * 0.5)}, 2.0)) + n * {num(r * 0.08)}, 0.0) / {num(r)}", u="(d - 1.0) / 0.25")
    rim = depth * 0.18
    return p.let(out=f"h + case when d < 1.0 then -{num(depth)} * pow(1.0 - d * d, 2.0) when d < 1.25 then {num(rim)} * (1.0 - u) * (1.0 - u) * 4.0 * u when d < 1.7 then {num(rim * 0.25)} * (1.0 - (d - 1.25) / 0.45) * (0.5 + 0.5 * n) else 0.0 end")


def _banded(p: Program, lo: float, size: float, o: Options, sharp: float, elev: str, spacing: str, phase: str) -> Program:
    """Binds q: h in bands whose place, interval and phase are shifted."""
    levels, height = max(2, round(o.amount)), o.extra.get("height_m", 0.0)
    base = height if height > 1e-4 else max(size / levels, 1e-4)
    riser = min(max(1.0 - min(max(sharp, 0.0), 1.0), 0.04), 0.92)
    tread, top = 1.0 - riser, min(max(o.extra.get("top", 0.15), 0.0), 1.0)
    p.let(
        step=f"greatest({num(base)} * (1.0 + ({spacing}) * 0.45), 1e-4)",
        ph0=f"{num(o.level)} + {phase}",
        ph="ph0 - floor(ph0)",
        bt=f"(h + ({elev}) * step * 0.55 - {num(lo)}) / step + ph",
        fr="bt - floor(bt)",
        ru=clamp(f"(fr - {num(tread)}) / {num(riser)}"),
        climbed=f"floor(bt) + case when fr <= {num(tread)} then 0.0 else {quintic('ru')} end",
        edge=f"case when fr <= {num(tread)} then {clamp(f'({num(tread)} - fr) / {num(max(tread, 1e-4))}')} else 0.0 end",
        soften=f"(1.0 - {quintic('edge')}) * {num(top * 0.65 if top > 1e-4 else 0.0)}",
        q=clamp(f"({num(lo)} + (climbed - ph) * step) * (1.0 - soften) + h * soften", lo, lo + size),
    )
    return p


def terrace_irregular(m: Metrics, o: Options, lo: float, hi: float) -> Program:
    """Terraces whose bands, spacing and risers wander with noise."""
    f, s = max(o.frequency, 1e-5), o.seed ^ 0x71CE
    p = Program().sample("perlin", el=(f"x * {num(f)}", f"z * {num(f)}", s)).sample("worley", ce=(f"x * {num(f * 0.85)}", f"z * {num(f * 0.85)}", s ^ 0x51CE))
    phasor(p, "wander", "x", "z", f * 0.7, s ^ 0xA11A)
    p.let(sp=f"{clamp('(ce2 - ce1) * 2.0 - 1.0', -1.0, 1.0)} * 0.35")
    return _banded(p, lo, max(hi - lo, 1e-5), o, o.extra.get("sharp", 0.55), "el", "sp", "wander * 0.5").let(out="q")


def terrace_steep(m: Metrics, o: Options, lo: float, hi: float) -> Program:
    """Terraces on steep ground alone, whose risers advance along the slope."""
    f = max(o.frequency, 1e-5)
    a, b = (10.0, 60.0) if o.slope_min <= 0.0 and o.slope_max >= 89.0 else (min(o.slope_min, o.slope_max), max(o.slope_min, o.slope_max))
    p = Program().sample("perlin", pn=(f"x * {num(f * 0.5)}", f"z * {num(f * 0.5)}", o.seed ^ 0x57EE))
    p.let(gate=clamp(f"(slope - {num(a)}) / {num(max(b - a, 1e-3))}"), w=quintic("gate"))
    return _banded(p, lo, max(hi - lo, 1e-5), o, o.extra.get("sharp", 0.95), "0.0", "0.0", f"pn * 0.15 + (x * gx + z * gz) * {num(f * 0.08)}").let(out="case when w >= 0.99999 then q when w <= 1e-5 then h else h * (1.0 - w) + q * w end")


def angle_break(m: Metrics, o: Options) -> Program:
    """Steps broken into faces along a direction, with a little deposit on the others."""
    f, step = max(o.frequency, 1e-5), max(o.amount * 0.45, 0.35)
    c, s = math.cos(math.radians(o.rotation_deg)), math.sin(math.radians(o.rotation_deg))
    lo, hi = min(o.slope_min, o.slope_max), max(o.slope_min, o.slope_max)
    p = gabor(warped(Program(), o), "n", "wx", "wz", f, o.seed ^ 0xA18E)
    p.let(g="1.0" if hi <= lo + 1e-3 else clamp(f"(slope - {num(lo)}) / {num(hi - lo)}"), aligned=clamp(f"abs(gx * {num(c)} + gz * {num(s)})"), mixed=f"{clamp('g * (0.35 + 0.65 * aligned)')} * 0.8")
    return p.let(out=f"case when g < 1e-4 then h else h * (1.0 - mixed) + floor(h / {num(step)} + n * 0.35) * {num(step)} * mixed + greatest(n, 0.0) * {num(o.amount * 0.15)} * (1.0 - aligned) * g end")


PROGRAMS = {"noise_gabor": gabor_noise, "noise_phasor": phasor_noise, "ridged": ridged_detail, "rugged": rugged, "scatter_detail": scatter_detail, "crater": crater, "angle_break": angle_break}
RANGED = {"terrace_irregular": terrace_irregular, "terrace_steep": terrace_steep}
SLOPED = frozenset({"angle_break", "terrace_steep"})


def unit_gradient(df: DataFrame, m: Metrics) -> DataFrame:
    """slope in degrees, and the unit vector gx, gz of forward differences (0 where flat)."""
    d = stencil.forward(df, m)
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gz") * F.col("gz"))
    d = d.withColumns({"slope": stencil.degrees(F.col("gx"), F.col("gz")), "__size": size})
    return d.withColumns({k: F.when(F.col("__size") < 1e-8, 0.0).otherwise(F.col(k) / F.col("__size")) for k in ("gx", "gz")}).drop("__size")


def _by_program(kind: str):
    def apply(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
        if kind in RANGED:
            lo, hi = df.agg(F.min("h"), F.max("h")).first()
            program = RANGED[kind](m, o, lo or 0.0, hi or 0.0)
        else:
            program = PROGRAMS[kind](m, o)
        d = unit_gradient(df, m) if kind in SLOPED else df
        return run(with_world(d, m), program, "out").withColumn("h", F.col("out")).select(*df.columns)

    return apply


# Filters that move or gather heights.


def _gathered(df: DataFrame, m: Metrics, program: Program, take) -> DataFrame:
    """h of the cell at the program's (u, v) in [0, 1], by take(u * (n - 1))."""
    d = run(with_world(df, m), program, "u", "v").select("i", "j", "h", "u", "v")
    got = combine.gather(d.select("i", "j", "h", "u", "v"), take(F.col("u") * (m.width - 1)), take(F.col("v") * (m.height - 1)), m)
    return df.drop("h").join(got.select("i", "j", "h"), ["i", "j"]).select(*df.columns)


def swirl_places(m: Metrics, o: Options) -> Program:
    f = max(o.frequency, 1e-5)
    p = Program().sample("perlin", n=(f"x * {num(f)}", f"z * {num(f)}", o.seed))
    p.let(cu=f"(i + 0.5) / {num(m.width)} - 0.5", cv=f"(j + 0.5) / {num(m.height)} - 0.5", a=f"(1.0 - sqrt(cu * cu + cv * cv)) * {num(max(o.amount, 0.1))} * (0.5 + n)")
    return p.let(u=clamp("0.5 + cu * cos(a) - cv * sin(a)"), v=clamp("0.5 + cu * sin(a) + cv * cos(a)"))


def distortion_places(m: Metrics, o: Options) -> Program:
    f = max(o.frequency, 1e-5)
    p = Program().sample("perlin", a=(f"x * {num(f)}", f"z * {num(f)}", o.seed), b=(f"x * {num(f)} + 17.0", f"z * {num(f)} + 9.0", o.seed ^ 0xA5A5))
    return p.let(u=clamp(f"(x + a * {num(o.amount)}) / {num(m.world_x)}"), v=clamp(f"(z + b * {num(o.amount)}) / {num(m.world_z)}"))


def _smooth_ridges(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    return stencil.box_mean(_by_program("ridged")(df, m, o), m, o.radius)


def _flatten(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    """Toward the level, or where that is 0 toward a mean of the window's median and near mean."""
    r, pull = max(1, o.radius), min(max(o.amount / (o.amount + 8.0) if o.amount > 1.0 else o.amount, 0.15), 0.95)
    h = F.col("h")
    if abs(o.level) > 1e-3:
        return df.withColumn("h", h * (1.0 - pull) + o.level * pull)
    d = stencil.neighbourhood(df, m, r)
    n = (2 * r + 1) ** 2
    weight = lambda x: F.exp(-(x.di * x.di + x.dj * x.dj).cast("double") / (r * r * 0.5 + 1e-3))
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda s, x: s + f(x))
    mid = F.element_at(F.array_sort(F.transform("near", lambda x: x.v)), n // 2 + 1)
    local = mid * 0.55 + total(lambda x: x.v * weight(x)) / total(weight) * 0.45
    return d.withColumn("h", h * (1.0 - pull) + local * pull).select(*df.columns)


def sectors_of(radius: int, sectors: int) -> list[list[tuple[int, int]]]:
    """Offsets within the radius by the sector that their angle is in."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(sectors)]
    for dj in range(-radius, radius + 1):
        for di in range(-radius, radius + 1):
            if (di or dj) and math.hypot(di, dj) <= radius + 1e-3:
                turn = math.atan2(dj, di) % math.tau
                out[next(s for s in range(sectors) if (s + 1) * math.tau / sectors > turn + 1e-9)].append((di, dj))
    return out


def _kuwahara(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    """The mean of the sector, the cell included, whose heights vary least."""
    r = max(1, o.radius)
    groups = sectors_of(r, 8 if o.radius >= 3 else 4)
    for _ in range(min(max(o.iterations, 1), 3)):
        d = stencil.neighbourhood(df, m, r)
        at = lambda di, dj: F.element_at("near", (dj + r) * (2 * r + 1) + di + r + 1).v
        h = F.col("h")
        sums = {f"__s{k}": sum((at(*p) for p in g), h) for k, g in enumerate(groups)} | {f"__q{k}": sum((at(*p) * at(*p) for p in g), h * h) for k, g in enumerate(groups)}
        d = d.withColumns(sums)
        rows = []
        for k, g in enumerate(groups):
            n = len(g) + 1.0
            mean = F.col(f"__s{k}") / n
            rows.append(F.struct(F.round(F.greatest(F.col(f"__q{k}") / n - mean * mean, F.lit(0.0)), 6).alias("var"), F.lit(k).alias("k"), mean.alias("mean")))
        df = d.withColumn("h", F.array_min(F.array(*rows)).mean).select(*df.columns)
    return df


def _angle_blur(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    """Gaussian mean along each cell's own gradient."""
    r = max(1, o.radius)
    sigma = max(r * 0.5, 0.5)
    d = stencil.neighbourhood(unit_gradient(df, m), m, r)
    flat = (F.col("gx") == 0.0) & (F.col("gz") == 0.0)
    d = d.withColumns({"gx": F.when(flat, 1.0).otherwise(F.col("gx"))})
    steps = [(k, math.exp(-k * k / (2.0 * sigma * sigma))) for k in range(-r, r + 1)]
    at = lambda k: F.element_at("near", ((F.floor(F.col("gz") * k + 0.5) + r) * (2 * r + 1) + F.floor(F.col("gx") * k + 0.5) + r + 1).cast("int")).v
    return d.withColumn("h", sum(at(k) * w for k, w in steps) / sum(w for _, w in steps)).select(*df.columns)


def _flow01(df: DataFrame, m: Metrics, passes: int) -> DataFrame:
    """flow over the field's largest."""
    d = hydrology.persisted(hydrology.multi_flow(df, m, passes))
    top = max(d.agg(F.max("flow")).first()[0] or 0.0, 1e-6)
    return d.withColumn("flow", cclamp(F.col("flow") / top))


def _above(threshold: float) -> Column:
    return cclamp((F.col("flow") - threshold) / max(1.0 - threshold, 1e-3))


def _soft_flows(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    d = stencil.box_mean(_flow01(df, m, 6), m, o.radius, out="__b")
    t0 = min(o.extra.get("flow_threshold", 0.2), 0.35)
    t = F.when(F.col("flow") >= t0, _above(t0)).otherwise(F.col("flow") * 0.35)
    h = F.col("h")
    return d.withColumn("h", h - F.least(F.abs(h - F.col("__b")), F.lit(max(o.amount, 0.5))) * t * 0.85).select(*df.columns)


def _thin_flows(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    t0 = max(o.extra.get("flow_threshold", 0.2), 0.05)
    return _flow01(df, m, 8).withColumn("h", F.col("h") - o.amount * F.pow(_above(t0), F.lit(1.6))).select(*df.columns)


def _ridged_flows(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    t0, f = o.extra.get("flow_threshold", 0.2), F.col("flow")
    change = F.when(f >= t0, -o.amount * _above(t0)).otherwise(o.amount * 0.35 * cclamp(1.0 - f / max(t0, 1e-3)))
    return _flow01(df, m, 7).withColumn("h", F.col("h") + change).select(*df.columns)


def _gently(o: Options) -> Column:
    """How far flow is over the threshold where the slope is under slope_max, and less the steeper it is."""
    t0 = o.extra.get("flow_threshold", 0.2)
    inside = (F.col("slope") <= o.slope_max) & (F.col("flow") >= t0)
    return F.when(inside, _above(t0) * (1.0 - F.col("slope") / max(o.slope_max, 1.0))).otherwise(0.0)


def _wide_flows(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    d = stencil.slope_forward(stencil.box_mean(_flow01(df, m, 6), m, max(o.radius, 2), out="__b"), m).withColumn("__t", _gently(o))
    h, t = F.col("h"), F.col("__t")
    return d.withColumn("h", h * (1.0 - t * 0.55) + (F.least(h, F.col("__b")) + o.amount * 0.15 * t) * t * 0.55).select(*df.columns)


def _sediment_flows(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    return stencil.slope_forward(_flow01(df, m, 8), m).withColumn("h", F.col("h") + o.amount * _gently(o)).select(*df.columns)


def _hydraulic_sediment(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    """Fans where a channel leaves steeper ground above it."""
    t0 = o.extra.get("flow_threshold", 0.2)
    d = stencil.slope_forward(_flow01(df, m, 8), m)
    d = stencil.near4(d, "h").withColumnsRenamed({k: f"__h{k}" for k in ("left", "right", "down", "up")})
    d = stencil.near4(d, "slope")
    # beyond the edge the cell itself repeats, which is not higher than itself
    steep = [F.when(F.col(f"__h{k}") > F.col("h"), F.col(k)).otherwise(0.0) for k in ("left", "right", "down", "up")]
    fan = cclamp((F.greatest(F.col("slope"), *steep) - F.col("slope")) / 25.0)
    t = F.when((F.col("flow") >= t0) & (F.col("slope") <= o.slope_max), _above(t0) * fan).otherwise(0.0)
    return d.withColumn("h", F.col("h") + o.amount * t).select(*df.columns)


def wind_steps(o: Options) -> list[tuple[int, float, float, float]]:
    """(k, x, z, weight) of the steps along the wind."""
    r, a = max(1, o.radius), math.radians(o.rotation_deg)
    return [(k, math.cos(a) * k, math.sin(a) * k, 1.0 - k / (r + 1.0)) for k in range(1, r + 1)]


def _wind_carve(df: DataFrame, m: Metrics, o: Options) -> DataFrame:
    """One pass of abrasion behind higher ground upwind and deposit before lower ground downwind."""
    r, f = max(1, o.radius), max(o.frequency, 1e-5)
    p = warped(Program(), o).sample("perlin", n=(f"wx * {num(f)}", f"wz * {num(f)}", o.seed ^ 0xA1AD)).let(gust="0.45 + abs(n) * 0.55")
    d = stencil.neighbourhood(run(with_world(df, m), p, "gust"), m, r)
    h = F.col("h")

    def mean(sign: int) -> Column:
        total, weight = F.lit(0.0), F.lit(0.0)
        for _, x, z, w in wind_steps(o):
            di, dj = math.floor(sign * x + 0.5), math.floor(sign * z + 0.5)
            inside = (F.col("i") + di).between(0, m.width - 1) & (F.col("j") + dj).between(0, m.height - 1)
            total = total + F.when(inside, F.element_at("near", (dj + r) * (2 * r + 1) + di + r + 1).v * w).otherwise(0.0)
            weight = weight + F.when(inside, w).otherwise(0.0)
        return F.when(weight > 1e-5, total / weight).otherwise(h)

    erode = F.least(F.greatest(mean(-1) - h, F.lit(0.0)) * 0.55, F.lit(o.amount))
    deposit = F.least(F.greatest(h - mean(1), F.lit(0.0)) * 0.25, F.lit(o.amount * 0.5))
    return d.withColumn("h", h + (deposit - erode) * F.col("gust")).select(*df.columns)


EFFECTS = {k: _by_program(k) for k in (*PROGRAMS, *RANGED)} | {
    "swirl": lambda df, m, o: _gathered(df, m, swirl_places(m, o), nearest_int),
    "distortion": lambda df, m, o: _gathered(df, m, distortion_places(m, o), F.floor),
    "smooth_ridges": _smooth_ridges,
    "flatten": _flatten,
    "kuwahara": _kuwahara,
    "angle_blur": _angle_blur,
    "soft_flows": _soft_flows,
    "thin_flows": _thin_flows,
    "ridged_flows": _ridged_flows,
    "wide_flows": _wide_flows,
    "sediment_flows": _sediment_flows,
    "hydraulic_sediment": _hydraulic_sediment,
    "wind_carve": _wind_carve,
}
FILTERS.update(EFFECTS)
