"""Landforms as field programs over the world coordinates x and z of cells.

Constants of the shapes are fixed values. A landform is evaluated cell by cell,
so any subset of cells (a tile, a region) gives the same heights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from ..functions.noise import Fractal, seed32
from ..functions.program import Program, clamp, ease, num, run
from .grid import Metrics, with_world


def _centred(m: Metrics, u: float, v: float) -> Program:
    cx, cz = min(max(u, 0.0), 1.0) * m.world_x, min(max(v, 0.0), 1.0) * m.world_z
    return Program().let(dx=f"x - {num(cx)}", dz=f"z - {num(cz)}", dist="sqrt(dx * dx + dz * dz)", theta="atan2(dz, dx)")


def mesa(m: Metrics, center_u=0.5, center_v=0.5, radius=0.42, height=180.0, edge_steepness=4.0, soft=0.25, cap_noise=6.0, seed=42) -> Program:
    """h: a flat cap, a steep wall with strata and a talus apron within a warped footprint."""
    short = max(min(m.world_x, m.world_z), 1.0)
    r = min(max(radius, 0.02), 1.0) * short * 0.5
    skirt = max(min(max(soft, 0.0), 1.0) * r, 1e-3)
    cap, top, f = r * 0.82, max(height, 0.0), 2.8 / max(r, 1.0)
    p = _centred(m, center_u, center_v)
    p.sample("perlin", edge=(f"x * {num(f)}", f"z * {num(f)}", seed ^ 0xE06351D3), broad=("x * 0.0031", "z * 0.0031", seed), fine=("x * 0.0097 + 13.0", "z * 0.0097 - 7.0", seed ^ 0xA7115CA1), scree=(f"x * {num(f * 5.0)}", f"z * {num(f * 5.0)}", seed ^ 0x7A1A5001))
    p.let(
        scale="greatest(1.0 + edge * 0.075 + sin(theta * 4.0 + edge) * 0.045 + sin(theta * 7.0 - edge * 0.7) * 0.025, 0.72)",
        d="dist / scale",
        detail=f"(broad * 0.72 + fine * 0.28) * {num(max(cap_noise, 0.0))}",
        wall=f"pow(1.0 - {clamp(f'(d - {num(cap)}) / {num(max(r - cap, 1e-3))}')}, {num(max(edge_steepness, 1.0))})",
        t=clamp(f"(d - {num(r)}) / {num(skirt)}"),
        apron=f"pow(greatest(1.0 - {ease('t')}, 0.0), 1.22)",
        h=f"case when d >= {num(r + skirt)} then 0.0 when d <= {num(cap)} then greatest({num(top)} + detail * 0.85, 0.0)"
        f" when d <= {num(r)} then greatest({num(top)} * wall * (0.95 + 0.05 * sin(wall * {num(11.0 * math.tau)} + edge * 1.8)) + detail * wall * 0.25, 0.0)"
        f" else greatest({num(top * 0.13)} * apron * (0.82 + 0.18 * scree), 0.0) end",
    )
    return p


def volcano(m: Metrics, center_u=0.5, center_v=0.5, radius=0.28, height=520.0, flank_power=1.35, crater_radius=0.18, crater_depth=85.0, roughness=18.0, seed=42) -> Program:
    """h: a warped cone with radial grooves, a rim and a crater bowl."""
    r = min(max(radius, 0.01), 1.0) * max(min(m.world_x, m.world_z), 1.0) * 0.5
    top, flank, f = max(height, 0.0), max(flank_power, 0.2), 3.2 / max(r, 1.0)
    crater, rough, depth = min(max(crater_radius, 0.0), 0.95), max(roughness, 0.0), max(crater_depth, 0.0)
    p = _centred(m, center_u, center_v)
    p.sample("perlin", macro=(f"x * {num(f)}", f"z * {num(f)}", seed ^ 0xA17C31D5), fine=(f"x * {num(f * 4.7)} + 11.0", f"z * {num(f * 4.7)} - 7.0", seed ^ 0xC011A953))
    p.let(
        radial=f"dist / ({num(r)} * greatest(1.0 + macro * 0.09 + sin(theta * 5.0 + macro * 1.7) * 0.035, 0.72))",
        u=clamp("1.0 - radial"),
        t=ease("u"),
        groove="pow(greatest(1.0 - abs(sin(theta * 11.0 + macro * 4.2 + fine * 0.9)), 0.0), 5.0)",
        g1=clamp("radial / 0.22"),
        g2=clamp("(1.0 - radial) / 0.18"),
        cone=f"{num(top)} * pow(t, {num(flank)}) + fine * {num(rough)} * t * 0.72 - groove * {num(rough * 1.35)} * {ease('g1')} * {ease('g2')}",
    )
    if crater * r > 1e-3:
        sigma = max(crater * 0.18, 0.012)
        s = min(max(1.0 - crater, 0.0), 1.0)
        floor = max(top * (s * s * (3.0 - 2.0 * s)) ** flank - depth, 0.0)
        p.let(rim=f"cone + exp(-pow((radial - {num(crater)}) / {num(sigma)}, 2.0)) * {num(depth * 0.22)}", b=clamp(f"1.0 - radial / {num(crater)}"), bowl=f"pow({ease('b')}, 1.35)", cone2=f"case when radial < {num(crater)} then rim * (1.0 - bowl) + {num(floor)} * bowl else rim end")
    else:
        p.let(cone2="cone")
    return p.let(h="case when radial >= 1.0 then 0.0 else greatest(cone2, 0.0) end")


def _corridor(m: Metrics, x: str, z: str, angle: float) -> dict[str, str]:
    c, s = math.cos(angle), math.sin(angle)
    return {"nx": f"{x} / {num(m.world_x)} - 0.5", "nz": f"{z} / {num(m.world_z)} - 0.5", "axis": f"nx * {num(c)} + nz * {num(s)}", "across": f"nx * {num(-s)} + nz * {num(c)}"}


def mountains(m: Metrics, base: Fractal = Fractal(seed=1, octaves=5, frequency=0.0015, amplitude=400.0), ridge_sharpness=1.8, range_angle=0.4, range_width=0.35, crest_detail=45.0) -> Program:
    """h: ridged crests within a warped range corridor, over macro ridges and foothills."""
    amp, f, scale = max(base.amplitude, 0.0), max(base.frequency, 1e-6), max(min(m.world_x, m.world_z), 1.0)
    shape = {"lacunarity": base.lacunarity, "persistence": base.persistence, "offset_x": base.offset_x, "offset_z": base.offset_z}
    large = Fractal(seed=base.seed, frequency=f * 0.52, octaves=min(max(base.octaves, 2), 4), amplitude=1.0, **shape)
    detail = Fractal(seed=base.seed ^ 0xC0DE, frequency=f * 4.5, octaves=4, amplitude=1.0, lacunarity=2.15, persistence=0.52, offset_x=base.offset_x, offset_z=base.offset_z)
    w = f * 0.31
    p = Program().let(**_corridor(m, "x", "z", range_angle))
    p.sample("perlin", wc=(f"x * {num(w)}", f"z * {num(w)}", base.seed ^ 0x7A11CE55), wa=(f"x * {num(w)} + 17.3", f"z * {num(w)} - 9.1", base.seed ^ 0x51D390AF), bias=(f"x * {num(w * 0.63)} + 3.7", f"z * {num(w * 0.63)} - 5.2", base.seed ^ 0xA8314F29))
    p.let(ac="across + wc * 0.085", ax="axis + wa * 0.035", ct=clamp(f"1.0 - abs(ac) / {num(max(range_width, 1e-3))}"), inside=f"pow({ease('ct')}, 1.18)", rx=f"ax * {num(scale)}", rz=f"ac * {num(scale)}")
    p.ridged("big", "rx", "rz", large).ridged("ridge", "rx", "rz", base).ridged("fine", "rx", "rz", detail)
    return p.let(
        structure=f"pow({clamp(f'ridge / {num(max(amp, 1e-6))}')} * 0.72 + {clamp('big')} * 0.28, {num(max(ridge_sharpness, 0.1))})",
        crests=f"{num(amp)} * inside * ((0.5 + 0.5 * bias) * pow(inside, 1.8) * 0.13 + structure * 0.87)",
        h=f"greatest(crests + (fine - 0.42) * {num(2.0 * max(crest_detail, 0.0))} * pow({clamp(f'crests / {num(max(amp, 1e-6))}')}, 0.68) * inside, 0.0)",
    )


def uplift(m: Metrics, seed=42, frequency=0.0009, amplitude=380.0, range_angle=0.55, corridor_width=0.42, ridge_power=1.6, warp_strength=0.35, detail_amplitude=45.0, detail_octaves=3, detail_frequency=0.004, altitude_fade=0.75) -> Program:
    """h: a warped ridge corridor whose detail fades with its height."""
    amp, fade = max(amplitude, 0.0), min(max(altitude_fade, 0.0), 1.0)
    f = frequency * 0.35
    p = Program().sample("perlin", ux=(f"x * {num(f)}", f"z * {num(f)}", seed), uz=(f"x * {num(f)} + 19.0", f"z * {num(f)} + 7.0", seed ^ 0xA5A5))
    p.let(xw=f"x + ux * {num(warp_strength * m.world_x * 0.08)}", zw=f"z + uz * {num(warp_strength * m.world_z * 0.08)}", **_corridor(m, "xw", "zw", range_angle))
    p.let(inside=f"pow(1.0 - {clamp(f'abs(across) / {num(max(corridor_width, 1e-3))}')}, 1.35)", rx=f"axis * {num(m.world_x)}", rz=f"across * {num(m.world_z)}")
    p.ridged("ridge", "rx", "rz", Fractal(seed=seed, octaves=3, frequency=frequency, amplitude=1.0, lacunarity=2.1, persistence=0.45))
    p.fbm("detail", "x", "z", Fractal(seed=seed ^ 0xC0FFEE, octaves=min(max(detail_octaves, 1), 8), frequency=max(detail_frequency, 1e-6), amplitude=max(detail_amplitude, 0.0), offset_x=11.0, offset_z=-3.0))
    p.let(crests=f"inside * pow(ridge, {num(max(ridge_power, 0.1))}) * {num(amp)}")
    lift = clamp(f"crests / {num(amp)}") if amp > 1e-6 else "0.0"
    return p.let(h=f"crests + detail * ({num(1.0 - fade)} + {num(fade)} * {lift})")


def canyons(m: Metrics, seed=42, depth=120.0, width=60.0, meander=0.6) -> Program:
    """h: minus the depth of a meandering canyon with a narrow inner cut; 0 outside."""
    w = max(width, 1e-3)
    f, phase = 1.0 / max(w * 11.0, 1.0), float(seed32(seed))
    p = Program().sample(
        "perlin", broad=(f"z * {num(f)}", num(phase * 0.017), seed), small=(f"z * {num(f * 3.1)}", num(phase * 0.043), seed ^ 0x9E37), wn=(f"z * {num(f * 0.83)} + 13.0", num(phase * 0.007), seed ^ 0x7F4A71C2), dn=(f"z * {num(f * 0.57)} - 5.0", "8.0", seed ^ 0xD3371A11)
    )
    p.let(centre=f"{num(m.world_x * 0.5)} + (broad * 0.72 + small * 0.28) * {num(min(max(meander, 0.0), 2.0) * w * 2.35)}", lw=f"{num(w)} * greatest(1.0 + wn * 0.28, 0.45)")
    p.sample("perlin", rough=("x / lw * 0.63", "z / lw * 0.47", seed ^ 0xC4110A55))
    return p.let(
        q="greatest(abs(x - centre) / lw + rough * 0.055, 0.0)",
        a=clamp("1.0 - q"),
        b=clamp("1.0 - q / 0.19"),
        h=f"case when q >= 1.0 then 0.0 else -{num(max(depth, 0.0))} * greatest(0.88 + dn * 0.16, 0.5) * (pow({ease('a')}, 0.72) * 0.78 + {ease('b')} * 0.22) * (0.96 + 0.04 * sin(q * {num(9.0 * math.tau)} + rough)) end",
    )


ISLAND_FIELDS = ("h", "land", "shore_distance", "bathymetry", "shelf", "beach", "reef", "mountain")


def island(
    m: Metrics, archetype="volcanic_high_island", seed=63, center_u=0.5, center_v=0.5, rotation_deg=18.0, radius=0.72, aspect=1.18, sea_level=0.0, ocean_floor=-180.0, mountain_height=520.0, shelf_width=260.0, shelf_depth=42.0, beach_width=70.0, beach_height=8.0,
    reef_width=150.0, reef_depth=4.0, coastline_warp=0.18, coastline_frequency=0.0012, mountain_power=1.55, ridge_strength=0.42, ridge_frequency=0.0032, lagoon_radius=0.48,
) -> Program:
    """ISLAND_FIELDS: an island from a warped signed distance to its shore; archetypes are volcanic_high_island, archipelago and atoll."""
    cell = max(m.dx, m.dz)
    base = min(max(radius, 0.08), 0.94) * max(min(m.world_x, m.world_z), 1.0) * 0.5
    root = math.sqrt(min(max(aspect, 0.35), 2.85))
    rx, rz = base * root, base / root
    cx, cz = min(max(center_u, 0.05), 0.95) * m.world_x, min(max(center_v, 0.05), 0.95) * m.world_z
    c, s, f = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg)), max(coastline_frequency, 1e-6)
    shelf, beach, reef = max(shelf_width, cell * 2.0), max(beach_width, cell), max(reef_width, cell)
    reef_at, sigma = min(shelf * 0.42, max(shelf - reef * 0.35, 0.0)), max(reef * 0.42, cell)
    floor, peak, dune = min(ocean_floor, sea_level - 1.0), max(mountain_height, 0.0), max(beach_height, 0.5)
    deep, lag, phase, sea = max(shelf_depth, 1.0), max(reef_depth, 0.5), float(seed32(seed)), num(sea_level)
    p = Program().let(dx=f"x - {num(cx)}", dz=f"z - {num(cz)}", xr=f"dx * {num(c)} + dz * {num(s)}", zr=f"dx * {num(-s)} + dz * {num(c)}")
    at = lambda k, a, b, key: (f"x * {num(f * k)} + {num(a)}", f"z * {num(f * k)} + {num(b)}", seed ^ key)
    p.sample("perlin", n1=at(1.0, 0.0, 0.0, 0), n2=at(2.17, 31.0, -19.0, 0xA17C9E5D), sw=at(0.55, 7.0, -11.0, 0xC04FFEE1), mass=at(0.38, 3.0, -4.0, 0xBA5171C5), dw=at(0.72, 0.0, 0.0, 0xD2A16E55))
    p.let(
        theta=f"atan2(zr / {num(rz)}, xr / {num(rx)})",
        lobes=f"sin(theta * 3.0 + {num(phase * 0.013)}) * 0.22 + sin(theta * 5.0 - {num(phase * 0.007)}) * 0.12",
        edge=f"greatest(1.0 + {num(min(max(coastline_warp, 0.0), 0.42))} * (n1 * 0.68 + n2 * 0.22 + lobes), 0.58)",
        rho0=f"sqrt(pow(xr / {num(rx)}, 2.0) + pow(zr / {num(rz)}, 2.0)) / edge",
    )
    rho = "rho0"
    if archetype == "archipelago":
        part = lambda ox, oz, k: f"sqrt(pow((xr / {num(rx)} - {num(ox)}) / {num(k * 0.58)}, 2.0) + pow((zr / {num(rz)} - {num(oz)}) / {num(k / 0.58)}, 2.0)) / greatest(edge, 0.7)"
        rho = f"least(rho0, {part(-0.42, 0.16, 0.62)}, {part(0.38, -0.2, 0.54)})"
    p.let(rho=rho, signed=f"(rho - 1.0) * {num(base)}" if archetype != "atoll" else f"greatest((rho - 1.0) * {num(base)}, ({num(min(max(lagoon_radius, 0.2), 0.78))} - rho) * {num(base)})")
    p.let(
        st=clamp(f"signed / {num(shelf)}"),
        band=f"exp(-pow((signed - {num(reef_at)}) / {num(sigma)}, 2.0))",
        sh=f"{sea} - {num(deep)} * pow(st, 1.35)",
        rh=f"{sea} - {num(lag)} - st * {num(lag * 0.35)}",
        ab=clamp(f"(signed - {num(shelf)}) / {num(shelf * 2.8)}"),
        outside=f"case when signed <= {num(shelf)} then greatest(sh, rh * band + sh * (1.0 - band)) else ({sea} - {num(deep)}) * (1.0 - {ease('ab')}) + {num(floor)} * {ease('ab')} end",
        inward="-signed",
    )
    if archetype == "atoll":
        p.let(inside=f"{sea} + {num(dune)} * sqrt({clamp(f'inward / {num(max(beach, 1.0))}')})")
    else:
        strength = min(max(ridge_strength, 0.0), 0.9)
        p.ridged("ridge", "x", "z", Fractal(seed=seed ^ 0x51ADE771, frequency=max(ridge_frequency, 1e-6), amplitude=1.0, octaves=5, lacunarity=2.05))
        p.fbm("detail", "x", "z", Fractal(seed=seed ^ 0xD37A11ED, frequency=max(ridge_frequency, 1e-6) * 3.4, amplitude=1.0, octaves=3, lacunarity=2.13, persistence=0.48, offset_x=7.0, offset_z=-13.0))
        p.let(
            bt=clamp(f"inward / {num(beach)}"),
            deepin=clamp(f"(inward - {num(beach)}) / {num(max(base * 0.82 - beach, 1.0))}"),
            spine=f"exp(-pow(zr + sw * {num(rz * 0.18)}, 2.0) / {num(2.0 * max((rz * 0.24) ** 2, 1.0))})",
            crest=clamp(f"{num(1.0 - strength)} + {num(strength)} * (ridge * 0.38 + spine * 0.47 + (0.5 + 0.5 * mass) * 0.15)", 0.18, 1.18),
            gully=f"pow(greatest(1.0 - abs(sin(theta * 9.0 + dw * 3.2)), 0.0), 6.0) * {ease('deepin')}",
            rise=f"pow(deepin, {num(max(mountain_power, 0.35))})",
            core=f"greatest({sea} + {num(dune)} + {num(peak)} * rise * crest - {num(peak * 0.105)} * gully * rise + detail * {num(peak * 0.055)} * {ease('deepin')}, {sea} + {num(dune)} + {num(peak * 0.012)} * deepin)",
            inside=f"case when inward <= {num(beach)} then {sea} + {num(dune)} * {ease('bt')} else core end",
        )
    return p.let(
        h="case when signed >= 0.0 then outside else inside end",
        land=f"case when h > {sea} then 1.0 else 0.0 end",
        shore_distance="signed",
        bathymetry=f"greatest({sea} - h, 0.0)",
        off="greatest(signed, 0.0)",
        shelf=f"{clamp(f'1.0 - off / {num(shelf)}')} * (1.0 - land)",
        beach=f"{clamp(f'1.0 - greatest(-signed, 0.0) / {num(beach)}')} * land",
        reef=f"exp(-pow((off - {num(reef_at)}) / {num(sigma)}, 2.0)) * (1.0 - land)",
        mountain=clamp(f"(h - {sea} - {num(beach_height)}) / {num(mountain_height)}") if mountain_height > 1e-3 else "0.0",
    )


def directional_phasor(p: Program, name: str, frequency: float, direction: float, linearity: float, seed: int) -> Program:
    """Binds name: banded waves across a direction in radians; low linearity mixes more lobes."""
    f, lin = max(frequency, 1e-5), min(max(linearity, 0.0), 1.0)
    c, s = math.cos(direction), math.sin(direction)
    n = 2 if lin > 0.75 else 3 if lin > 0.4 else 4
    p.let(**{f"{name}_al": f"x * {num(c)} + z * {num(s)}", f"{name}_ac": f"x * {num(-s)} + z * {num(c)}"})
    al, ac = f"{name}_al", f"{name}_ac"
    p.sample("simplex", **{f"{name}_y{k}": (f"{ac} * {num(f * 0.12)} + {num(k * 2.7)}", f"{al} * {num(f * 0.05)}", seed + 9173 * k) for k in range(n)}, **{f"{name}_w{k}": (f"x * {num(f * 0.08)}", f"z * {num(f * 0.08)}", (seed + 9173 * k) ^ 0x51AF) for k in range(n)})
    p.sample("value", **{f"{name}_a{k}": (f"{ac} * {num(f * 0.18)}", f"{al} * {num(f * 0.11)}", (seed + 9173 * k) ^ 0xC0DE) for k in range(n)})
    re, im = [], []
    for k in range(n):
        p.let(**{f"{name}_t{k}": f"{num(direction)} + {name}_y{k} * {num(math.pi * (1.0 - lin) * 0.55)}"})
        p.let(**{f"{name}_p{k}": f"(x * cos({name}_t{k}) + z * sin({name}_t{k})) * {num(f * math.tau)} + {name}_w{k} * {num(math.pi * (0.35 + 0.65 * (1.0 - lin)))}"})
        weight = 1.0 if k == 0 else (1.0 - lin) ** 0.65
        re.append(f"(0.6 + 0.4 * abs({name}_a{k})) * {num(weight)} * cos({name}_p{k})")
        im.append(f"(0.6 + 0.4 * abs({name}_a{k})) * {num(weight)} * sin({name}_p{k})")
    p.let(**{f"{name}_re": " + ".join(re), f"{name}_im": " + ".join(im)})
    return p.let(**{name: clamp(f"tanh(sqrt({name}_re * {name}_re + {name}_im * {name}_im) * 1.1) * 2.0 - 1.0", -1.0, 1.0)})


def dune_sand(m: Metrics, direction_deg=20.0, dune_scale=0.012, dune_height=18.0, sand_supply=0.8, crest_sharpness=0.6, linearity=0.7, seed=42) -> Program:
    """h: thickness of the sand that dunes start from."""
    angle, f, supply, height = math.radians(direction_deg), max(dune_scale, 1e-5), min(max(sand_supply, 0.0), 2.0), max(dune_height, 0.0)
    sharp, lin = min(max(crest_sharpness, 0.0), 1.0), min(max(linearity, 0.0), 1.0)
    p = directional_phasor(Program(), "ph", f, angle, lin, seed)
    p.sample("perlin", rip=(f"ph_al * {num(f * 5.5)}", f"ph_ac * {num(f * 1.1)}", seed ^ 0x51F7E001))
    p.let(shaped=f"pow({clamp('0.5 + 0.5 * ph')}, {num(0.55 + sharp * 1.1)})")
    second = "0.0"
    if lin < 0.85:
        directional_phasor(p, "pk", f * 0.92, angle + math.pi / 2 * (1.0 - lin), lin, seed ^ 0xA11C)
        second = f"pow({clamp('0.5 + 0.5 * pk')}, 0.7) * {num((1.0 - lin) * 0.55)}"
    profile = clamp(f"shaped * {num(0.65 + 0.35 * lin)} + {second} + abs(rip * 0.06 * shaped)")
    return p.let(h=f"{num(height * supply * 0.22)} + {num(height * supply * (0.55 + 0.45 * min(supply, 1.0)))} * {profile}")


LANDFORMS = {"mesa": mesa, "volcano": volcano, "mountains": mountains, "uplift": uplift, "canyons": canyons, "island": island, "dune_sand": dune_sand}


def landform(cells: DataFrame, m: Metrics, kind: str, **params) -> DataFrame:
    """cells (i, j) with the heights of a landform, or with ISLAND_FIELDS."""
    fields = ISLAND_FIELDS if kind == "island" else ("h",)
    return run(with_world(cells, m), LANDFORMS[kind](m, **params), *fields).drop("x", "z")
