"""Queries of landforms, effect programs and field masks, with their SQL; registered beside those of catalog."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import masks, noise
from ..functions.program import Program, run
from ..operators import combine, effects, filters, hydrology, pointwise, rock
from ..sources import grid as source
from ..sources import landforms
from .base import GRID, M, grid, rounded, with_grid
from .catalog import _FLOW, _GRAD8, _N4, _P, _PATHS, _PERLIN, _VALUE, ORACLE_SQL, _lattice_sql, _square, clamp_sql, query

#: The map that landforms are drawn on.
MAP = source.Metrics(40, 32, 3200.0, 2560.0, tile=8)


def program_sql(p: Program, base: str, columns: set[str], tag: str = "p") -> tuple[str, str]:
    """(stages, last name) of a program over a relation with those columns."""
    stages, last, have = [], base, set(columns)

    def stage(select: str) -> None:
        nonlocal last
        name = f"{tag}{len(stages)}"
        stages.append(f"{name} AS ({select.format(last=last)})")
        last = name

    def lattice(x: str, z: str, s: int) -> str:
        return _lattice_sql(x, z, noise.seed32(s))

    for kind, what in p.steps:
        for name, step in what.items():
            if kind == "let":
                stage(f"SELECT * {'REPLACE' if name in have else ','} {'(' if name in have else ''}CAST({step} AS DOUBLE) AS {name}{')' if name in have else ''} FROM {{last}}")
                have.add(name)
                continue
            x, z, s = step
            if kind == "hash":
                stage(f"SELECT *, {lattice(f'CAST({x} AS BIGINT)', f'CAST({z} AS BIGINT)', s)} AS {name} FROM {{last}}")
            elif kind in ("perlin", "value"):
                stage(f"SELECT *, CAST({x} AS DOUBLE) AS px, CAST({z} AS DOUBLE) AS pz, CAST(floor({x}) AS BIGINT) AS ix, CAST(floor({z}) AS BIGINT) AS iz FROM {{last}}")
                stage(f"SELECT *, px - ix AS fx, pz - iz AS fz, {lattice('ix', 'iz', s)} AS h00, {lattice('ix + 1', 'iz', s)} AS h10, {lattice('ix', 'iz + 1', s)} AS h01, {lattice('ix + 1', 'iz + 1', s)} AS h11 FROM {{last}}")
                stage(f"SELECT * EXCLUDE (px, pz, ix, iz, fx, fz, h00, h10, h01, h11), {_PERLIN if kind == 'perlin' else _VALUE} AS {name} FROM {{last}}")
            elif kind == "simplex":
                f, g = f"{noise.SKEW}::DOUBLE", f"{noise.UNSKEW}::DOUBLE"
                part = lambda h, a, b: f"CASE WHEN 0.5 - {a} * {a} - {b} * {b} < 0 THEN 0 ELSE (0.5 - {a} * {a} - {b} * {b}) ** 4 * ({_GRAD8(h, a, b)}) END"
                stage(f"SELECT *, CAST({x} AS DOUBLE) AS px, CAST({z} AS DOUBLE) AS pz FROM {{last}}")
                stage(f"SELECT *, floor(px + (px + pz) * {f}) AS ci, floor(pz + (px + pz) * {f}) AS cj FROM {{last}}")
                stage(f"SELECT *, px - (ci - (ci + cj) * {g}) AS x0, pz - (cj - (ci + cj) * {g}) AS z0 FROM {{last}}")
                stage("SELECT *, CASE WHEN x0 > z0 THEN 1 ELSE 0 END AS i1, CASE WHEN x0 > z0 THEN 0 ELSE 1 END AS j1 FROM {last}")
                stage(f"SELECT *, x0 - i1 + {g} AS x1, z0 - j1 + {g} AS z1, x0 - 1 + 2 * {g} AS x2, z0 - 1 + 2 * {g} AS z2, {lattice('ci', 'cj', s)} AS h0, {lattice('ci + i1', 'cj + j1', s)} AS h1, {lattice('ci + 1', 'cj + 1', s)} AS h2 FROM {{last}}")
                stage(f"SELECT * EXCLUDE (px, pz, ci, cj, x0, z0, i1, j1, x1, z1, x2, z2, h0, h1, h2), 40 * ({part('h0', 'x0', 'z0')} + {part('h1', 'x1', 'z1')} + {part('h2', 'x2', 'z2')}) AS {name} FROM {{last}}")
            else:  # worley
                stage(f"SELECT *, CAST({x} AS DOUBLE) AS px, CAST({z} AS DOUBLE) AS pz, CAST(floor({x}) AS BIGINT) AS ix, CAST(floor({z}) AS BIGINT) AS iz FROM {{last}}")
                gap = lambda a, b: f"sqrt((px - (ix + {a} + {lattice(f'ix + {a}', f'iz + {b}', s)} / 4294967295.0::DOUBLE)) ** 2 + (pz - (iz + {b} + {_lattice_sql(f'ix + {a}', f'iz + {b}', noise.seed32(s) ^ noise.SECOND_SEED)} / 4294967295.0::DOUBLE)) ** 2)"
                stage(f"SELECT *, list_sort([{', '.join(gap(a, b) for b in (-1, 0, 1) for a in (-1, 0, 1))}]) AS near FROM {{last}}")
                stage(f"SELECT * EXCLUDE (px, pz, ix, iz, near), near[1] AS {name}1, near[2] AS {name}2 FROM {{last}}")
    return ", ".join(stages), last


# ------------------------------------------------------------------ landforms

_MAP_CELLS = f"c AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, (a.range + 0.5) * {MAP.dx}::DOUBLE AS x, (b.range + 0.5) * {MAP.dz}::DOUBLE AS z FROM range({MAP.width}) a, range({MAP.height}) b)"


def _landform(name: str, kind: str, **params) -> None:
    fields = landforms.ISLAND_FIELDS if kind == "island" else ("h",)
    stages, last = program_sql(landforms.LANDFORMS[kind](MAP, **params), "c", {"i", "j", "x", "z"})
    sql = f"WITH {_MAP_CELLS}, {stages} SELECT i, j, {', '.join(f'round({k}, 6) + 0.0 AS {k}' for k in fields)} FROM {last}"
    query(name, sql)(lambda spark, sf_dir: rounded(landforms.landform(source.cells(spark, MAP), MAP, kind, **params), digits=6))


_landform("landform_mesa", "mesa")
_landform("landform_volcano", "volcano")
_landform("landform_mountains", "mountains")
_landform("landform_uplift", "uplift")
_landform("landform_canyons", "canyons")
_landform("landform_island", "island")
_landform("landform_archipelago", "island", archetype="archipelago")
_landform("landform_atoll", "island", archetype="atoll")
_landform("landform_dune_sand", "dune_sand", linearity=0.5)


@query("landform_tiles", f"WITH {_MAP_CELLS}, {program_sql(landforms.volcano(MAP), 'c', {'i', 'j', 'x', 'z'})[0]} SELECT i, j, round(h, 6) + 0.0 AS h FROM {program_sql(landforms.volcano(MAP), 'c', {'i', 'j', 'x', 'z'})[1]} WHERE (i // 8 + j // 8) % 2 = 0")
def landform_tiles(spark, sf_dir):
    """A landform of some tiles alone."""
    tiles = source.with_tiles(source.cells(spark, MAP), MAP).select("tx", "tz").distinct().where("(tx + tz) % 2 = 0")
    return rounded(landforms.landform(source.only_tiles(source.cells(spark, MAP), tiles, MAP), MAP, "volcano"), digits=6)


# ------------------------------------------------------------------ effect programs

_SLOPED = """gs AS (SELECT i, j, h, x, z, degrees(atan(sz)) AS slope, CASE WHEN sz < 1e-8 THEN 0 ELSE ax / sz END AS gx, CASE WHEN sz < 1e-8 THEN 0 ELSE az / sz END AS gz FROM
  (SELECT *, (i + 0.5) * 10.0::DOUBLE AS x, (j + 0.5) * 10.0::DOUBLE AS z, (hr - h) / 10 AS ax, (hu - h) / 10 AS az, sqrt(((hr - h) / 10) ** 2 + ((hu - h) / 10) ** 2) AS sz FROM n) t)"""
_COLUMNS = {"i", "j", "h", "x", "z", "slope", "gx", "gz"}


def _run(kind: str, o: filters.Options, digits: int):
    return lambda spark, sf_dir: rounded(filters.apply(grid(spark, sf_dir), M, kind, o), digits=digits)


def _effect(kind: str, o: filters.Options, digits: int = 6) -> None:
    stages, last = program_sql(effects.PROGRAMS[kind](M, o), "gs", _COLUMNS)
    query(f"filter_{kind}", with_grid(f"SELECT i, j, round(out, {digits}) + 0.0 AS h FROM {last}", f"{_N4}, {_SLOPED}, {stages}"))(_run(kind, o, digits))


_effect("noise_gabor", filters.Options(amount=6.0, frequency=0.02, octaves=2, seed=9, rotation_deg=30.0, anisotropy=1.4))
_effect("noise_phasor", filters.Options(amount=6.0, frequency=0.02, octaves=2, seed=9, rotation_deg=30.0))
_effect("ridged", filters.Options(amount=6.0, frequency=0.01, seed=9))
_effect("rugged", filters.Options(amount=6.0, frequency=0.01, seed=9))
_effect("scatter_detail", filters.Options(amount=6.0, frequency=0.02, seed=9, extra={"warp_strength": 12.0, "warp_frequency": 0.01}))
_effect("crater", filters.Options(amount=30.0, frequency=0.02, seed=9))
_effect("angle_break", filters.Options(amount=6.0, frequency=0.02, seed=9, slope_min=10.0, slope_max=60.0, rotation_deg=25.0))


def _ranged(kind: str, o: filters.Options) -> None:
    """Terraces read the grid's range, which the SQL finds itself: the program is written for a range of 0 to 1 over scaled heights."""
    marks = (1234567.25, 7654321.5)  # stand for lowest and highest, replaced by columns
    p = effects.RANGED[kind](M, o, *marks)
    names = {repr(marks[0]): "lo", repr(marks[1]): "hi", repr(marks[1] - marks[0]): "(hi - lo)", repr((marks[1] - marks[0]) / max(2, round(o.amount))): f"((hi - lo) / {max(2, round(o.amount))})"}
    stages, last = program_sql(p, "gr2", _COLUMNS)
    for number, name in names.items():
        stages = stages.replace(f"({number}e0)", name)  # as doubles() writes it
    assert "1234567" not in stages and "7654321" not in stages
    query(f"filter_{kind}", with_grid(f"SELECT i, j, round(out, 6) + 0.0 AS h FROM {last}", f"{_N4}, {_SLOPED}, gr2 AS (SELECT *, min(h) OVER () AS lo, max(h) OVER () AS hi FROM gs), {stages}"))(_run(kind, o, 6))


_ranged("terrace_irregular", filters.Options(amount=6.0, frequency=0.01, seed=9))
_ranged("terrace_steep", filters.Options(amount=6.0, frequency=0.01, seed=9))


def _gather(kind: str, places, o: filters.Options, take: str) -> None:
    stages, last = program_sql(places(M, o), "gs", _COLUMNS)
    query(f"filter_{kind}", with_grid(f"SELECT p.i, p.j, round(g.h, 9) + 0.0 AS h FROM {last} p JOIN g ON g.i = {take}(u * 31) AND g.j = {take}(v * 31)", f"{_N4}, {_SLOPED}, {stages}"))(_run(kind, o, 9))


_gather("swirl", effects.swirl_places, filters.Options(amount=0.8, frequency=0.013, seed=9), "round")
_gather("distortion", effects.distortion_places, filters.Options(amount=25.0, frequency=0.013, seed=9), "floor")

_FLAT = "exp(-(a.range * a.range + b.range * b.range) / (4 * 0.5 + 1e-3)::DOUBLE)"
query("filter_flatten", with_grid(_square(f"round(g.h * (1 - 0.6) + (list_sort(list(o.h))[13] * 0.55 + sum(o.h * {_FLAT}) / sum({_FLAT}) * 0.45) * 0.6, 8) + 0.0 AS h")))(_run("flatten", filters.Options(amount=0.6, radius=2), 8))
_SECTORS = ", ".join(f"({k}, {di}, {dj})" for k, s in enumerate(effects.sectors_of(2, 4)) for di, dj in [(0, 0), *s])
query("filter_kuwahara", with_grid(f"""SELECT i, j, round(first(mean ORDER BY var, k), 8) + 0.0 AS h FROM (SELECT g.i, g.j, s.k, avg(o.h) AS mean, round(greatest(avg(o.h * o.h) - avg(o.h) ** 2, 0), 6) AS var FROM g, (VALUES {_SECTORS}) s(k, di, dj), g o
  WHERE o.i = least(31, greatest(0, g.i + s.di)) AND o.j = least(31, greatest(0, g.j + s.dj)) GROUP BY 1, 2, 3) t GROUP BY i, j"""))(_run("kuwahara", filters.Options(radius=2), 8))
query("filter_angle_blur", with_grid("""SELECT s.i, s.j, round(sum(o.h * w) / sum(w), 8) + 0.0 AS h FROM (SELECT *, CASE WHEN gx = 0 AND gz = 0 THEN 1 ELSE gx END AS ux FROM gs) s, (SELECT range AS k, exp(-range * range / 2.0::DOUBLE) AS w FROM range(-2, 3)) t, g o
  WHERE o.i = least(31, greatest(0, s.i + floor(ux * k + 0.5))) AND o.j = least(31, greatest(0, s.j + floor(gz * k + 0.5))) GROUP BY 1, 2""", f"{_N4}, {_SLOPED}"))(_run("angle_blur", filters.Options(radius=2), 8))


def _flow_ctes(passes: int, radius: int) -> str:
    """fb: slope, mean of the square and flow over its largest after so many passes."""
    out = [_FLOW, "sh AS (SELECT i, j, i + di AS ti, j + dj AS tj, s / sum(s) OVER (PARTITION BY i, j) AS p FROM e WHERE s > 0)", "w0 AS (SELECT i, j, 1.0::DOUBLE AS flow FROM g)"]
    for k in range(passes):
        out.append(f"w{k + 1} AS (SELECT g.i, g.j, 1 + coalesce(sum(w.flow * sh.p), 0) AS flow FROM g LEFT JOIN sh ON sh.ti = g.i AND sh.tj = g.j LEFT JOIN w{k} w ON w.i = sh.i AND w.j = sh.j GROUP BY 1, 2)")
    return ", ".join([*out, _N4, _SLOPED, f"fb AS (SELECT gs.*, b, flow / max(flow) OVER () AS f FROM gs JOIN w{passes} USING (i, j) JOIN ({_square('avg(o.h) AS b', radius)}) q USING (i, j))"])


def _flow_filter(kind: str, passes: int, radius: int, expr: str, o: filters.Options, more: str = "", src: str = "fb") -> None:
    query(f"filter_{kind}", with_grid(f"SELECT i, j, round({expr}, 7) + 0.0 AS h FROM {src}", _flow_ctes(passes, radius) + more))(_run(kind, o, 7))


_OF = filters.Options(amount=5.0, radius=2, slope_max=70.0, extra={"flow_threshold": 0.2})
_T = clamp_sql("(f - 0.2) / 0.8")
_GENTLE = f"CASE WHEN slope <= 70 AND f >= 0.2 THEN {_T} * (1 - slope / 70.0) ELSE 0 END"
_flow_filter("soft_flows", 6, 2, f"h - least(abs(h - b), 5.0::DOUBLE) * CASE WHEN f >= 0.2 THEN {_T} ELSE f * 0.35 END * 0.85", _OF)
_flow_filter("thin_flows", 8, 1, f"h - 5 * {_T} ** 1.6", _OF)
_flow_filter("ridged_flows", 7, 1, f"h + CASE WHEN f >= 0.2 THEN -5 * {_T} ELSE 5 * 0.35 * {clamp_sql('1 - f / 0.2')} END", _OF)
_flow_filter("wide_flows", 6, 2, "h * (1 - t * 0.55) + (least(h, b) + 5 * 0.15 * t) * t * 0.55", _OF, f", ft AS (SELECT *, {_GENTLE} AS t FROM fb)", "ft")
_flow_filter("sediment_flows", 8, 1, f"h + 5 * {_GENTLE}", _OF)
_flow_filter("hydraulic_sediment", 8, 1, f"h + CASE WHEN f >= 0.2 AND slope <= 70 THEN 5 * {_T} * {clamp_sql('(greatest(slope, up) - slope) / 25.0')} ELSE 0 END", _OF, ", ft AS (SELECT fb.i, fb.j, fb.h, fb.f, fb.slope, coalesce(max(o.slope) FILTER (WHERE o.h > fb.h), 0) AS up FROM fb JOIN gs o ON abs(o.i - fb.i) + abs(o.j - fb.j) = 1 GROUP BY 1, 2, 3, 4, 5)", "ft")

_OW = filters.Options(amount=5.0, radius=3, frequency=0.02, seed=9, rotation_deg=35.0)
_WIND = ", ".join(f"({side}, {math.floor(sign * x + 0.5)}, {math.floor(sign * z + 0.5)}, {w!r}::DOUBLE)" for side, sign in ((0, -1), (1, 1)) for _, x, z, w in effects.wind_steps(_OW))
_GUST = effects.warped(Program(), _OW).sample("perlin", n=("wx * 0.02", "wz * 0.02", 9 ^ 0xA1AD)).let(gust="0.45 + abs(n) * 0.55")
_GUSTED, _GUST_LAST = program_sql(_GUST, "gs", _COLUMNS)
query("filter_wind_carve", with_grid(f"""SELECT i, j, round(h + (least(greatest(h - coalesce(lee, h), 0) * 0.25, 2.5::DOUBLE) - least(greatest(coalesce(wind, h) - h, 0) * 0.55, 5.0::DOUBLE)) * gust, 7) + 0.0 AS h FROM
  (SELECT s.i, s.j, s.h, s.gust, sum(o.h * w.w) FILTER (WHERE w.side = 0) / sum(w.w) FILTER (WHERE w.side = 0 AND o.h IS NOT NULL) AS wind, sum(o.h * w.w) FILTER (WHERE w.side = 1) / sum(w.w) FILTER (WHERE w.side = 1 AND o.h IS NOT NULL) AS lee
   FROM {_GUST_LAST} s CROSS JOIN (VALUES {_WIND}) w(side, di, dj, w) LEFT JOIN g o ON o.i = s.i + w.di AND o.j = s.j + w.dj GROUP BY 1, 2, 3, 4) t""", f"{_N4}, {_SLOPED}, {_GUSTED}"))(_run("wind_carve", _OW, 7))
query("filter_smooth_ridges", with_grid(f"SELECT g.i, g.j, round(avg(o.out), 6) + 0.0 AS h FROM g, range(-1, 2) a, range(-1, 2) b, (SELECT i, j, out FROM {program_sql(effects.ridged_detail(M, filters.Options(amount=6.0, frequency=0.01, seed=9)), 'gs', _COLUMNS)[1]}) o WHERE o.i = least(31, greatest(0, g.i + a.range)) AND o.j = least(31, greatest(0, g.j + b.range)) GROUP BY 1, 2", f"{_N4}, {_SLOPED}, {program_sql(effects.ridged_detail(M, filters.Options(amount=6.0, frequency=0.01, seed=9)), 'gs', _COLUMNS)[0]}"))(_run("smooth_ridges", filters.Options(amount=6.0, frequency=0.01, seed=9, radius=1), 6))


# ------------------------------------------------------------------ rock

_RV = f"""rv AS (SELECT d.i, d.j, greatest(pl, 0) * (0.35 + 0.65 * s) AS ridge, greatest(-pl, 0) * (1 - 0.4 * s) AS valley, s, pr FROM (SELECT d.i, d.j, degrees(atan(sqrt(p * p + q * q))) / 90 AS s, plan / greatest(max(abs(plan)) OVER (), 1e-6) AS pl, profile / greatest(max(abs(profile)) OVER (), 1e-6) AS pr FROM d JOIN w USING (i, j)) d)"""
_ROCK = f"{_N4}, {_P}, {_RV}, {_SLOPED}"


@query("ridge_valley", with_grid("SELECT i, j, round(ridge, 7) + 0.0 AS ridge, round(valley, 7) + 0.0 AS valley FROM rv", _ROCK))
def ridge_valley(spark, sf_dir):
    return rounded(rock.ridge_valley(grid(spark, sf_dir), M, 12.0).select("i", "j", "ridge", "valley"), digits=7)


@query("detect_cliffs", with_grid(f"""SELECT i, j, round(g * g * (3 - 2 * g), 6) + 0.0 AS cliff FROM (SELECT i, j, {clamp_sql('(k / max(k) OVER () - 0.25) / 0.55')} AS g FROM (SELECT n.i, n.j,
  {clamp_sql('(greatest(h, hl, hr, hd, hu) - least(h, hl, hr, hd, hu)) / (0.5 * 10 * 4)')} * 0.45 + {clamp_sql('(s * 90 - 12) / 78')} * 0.40 + abs(pr) * 0.15 AS k FROM n JOIN rv USING (i, j)) t) q""", _ROCK))
def detect_cliffs(spark, sf_dir):
    return rounded(rock.cliffs(grid(spark, sf_dir), M, 1, 0.5, 12.0).select("i", "j", "cliff"), digits=6)


_LOW = "gl AS (SELECT *, min(h) OVER () AS lo FROM gs)"
_BEDS = {"tilted": ("tilted", 12.0, 45.0), "folded": ("folded", 9.0, 60.0, 9), "warped": rock.rock_beds(0.03, 0.6, 9), "horizontal": ("horizontal",)}


def _beds(name: str, geometry: tuple) -> None:
    stages, last = program_sql(rock.beds(0.03, 0.6, geometry), "gl", {*_COLUMNS, "lo"})
    query(f"strata_{name}", with_grid(f"SELECT i, j, round(strat, 7) + 0.0 AS strat, hardness, erodibility, layer FROM {last}", f"{_N4}, {_SLOPED}, {_LOW}, {stages}"))(
        lambda spark, sf_dir: rounded(run(source.with_world(_lowest(grid(spark, sf_dir)), M), rock.beds(0.03, 0.6, geometry), "strat", "hardness", "erodibility", "layer").select("i", "j", "strat", "hardness", "erodibility", "layer"), "strat", digits=7)
    )


def _lowest(df):
    return df.withColumn("lo", F.lit(df.agg(F.min("h")).first()[0]))


for _name, _geometry in _BEDS.items():
    _beds(_name, _geometry)

_FACE = "((i * 7 + j * 13) % 11) / 10.0::DOUBLE"
_EXPOSED, _EXPOSED_LAST = program_sql(rock.beds(0.03, 0.6, _BEDS["warped"]), "gl", {*_COLUMNS, "lo"})


@query("expose_strata", with_grid(f"SELECT i, j, round(h - soft * 8 * face + CASE WHEN soft < 0.35 THEN soft * 8 * 0.15 * face ELSE 0 END, 8) + 0.0 AS h FROM (SELECT *, 1 - hardness AS soft, {_FACE} AS face FROM {_EXPOSED_LAST}) t", f"{_N4}, {_SLOPED}, {_LOW}, {_EXPOSED}"))
def expose_strata(spark, sf_dir):
    d = rock.with_beds(grid(spark, sf_dir), M, 0.03, 0.6, _BEDS["warped"])
    return rounded(rock.expose(d.withColumn("face", ((F.col("i") * 7 + F.col("j") * 13) % 11) / 10.0), 8.0, "face").select("i", "j", "h"), digits=8)


def _field(name: str, program: Program, out: str, digits: int, reads: str = "gs", columns: set[str] = _COLUMNS, prepare=lambda df: df) -> None:
    """A query of one field of a program over the grid."""
    stages, last = program_sql(program, reads, columns)
    more = {"gs": "", "gl": f", {_LOW}", "gr": ", gr AS (SELECT gs.*, ridge FROM gs JOIN rv USING (i, j))"}[reads]
    query(name, with_grid(f"SELECT i, j, round({out}, {digits}) + 0.0 AS {out} FROM {last}", f"{_ROCK}{more}, {stages}"))(lambda spark, sf_dir: rounded(run(source.with_world(prepare(grid(spark, sf_dir)), M), program, out).select("i", "j", out), digits=digits))


_field("strata_band_displace", rock.band_program(0.03, 6.0, 9), "out", 7, "gl", {*_COLUMNS, "lo"}, _lowest)
_field("fracture_field", rock.fracture_program(0.03, 9, 2), "frac", 7)
_field("lithology_hardness", rock.lithology_program(0.5, 0.02, 9), "hardness", 8)
_field("enhance_ridges", rock.ridge_program(6.0, 10.0, 60.0, 0.01, 9, False), "out", 6, "gr", {*_COLUMNS, "ridge"}, lambda df: effects.unit_gradient(rock.ridge_valley(df, M, 12.0), M))
_field("gabor_kernel", effects.gabor(Program(), "gab", "x", "z", 0.02, 9), "gab", 7)
_field("phasor_kernel", effects.phasor(Program(), "pha", "x", "z", 0.02, 9), "pha", 7)
_field("phasor_directional", landforms.directional_phasor(Program(), "pha", 0.02, 0.6, 0.5, 9), "pha", 7)

_STRIP = "(1 - (0.2 + 0.6 * (((i * 7 + j * 13) % 11) / 10.0::DOUBLE))) * (1 - ridge * 0.85) * 0.8"


@query("differential_erode", with_grid(f"SELECT i, j, round(h + (least(h, m) - h) * {clamp_sql('k')}, 7) + 0.0 AS h FROM (SELECT g.i, g.j, g.h, avg(o.h) AS m, {_STRIP.replace('(i *', '(g.i *').replace('+ j *', '+ g.j *')} AS k FROM g JOIN rv ON rv.i = g.i AND rv.j = g.j JOIN g o ON abs(o.i - g.i) <= 1 AND abs(o.j - g.j) <= 1 GROUP BY g.i, g.j, g.h, ridge) t", _ROCK))
def differential_erode(spark, sf_dir):
    d = grid(spark, sf_dir).withColumn("hardness", 0.2 + 0.6 * (((F.col("i") * 7 + F.col("j") * 13) % 11) / 10.0))
    return rounded(rock.differential_erode(d, M, 0.8, 1, radius_m=10.0).select("i", "j", "h"), digits=7)


_OR = filters.Options(amount=6.0, frequency=0.02, radius=1, seed=9, slope_min=5.0, slope_max=60.0, extra={"rock_hardness": 0.5})
for _name in ("rocky_sharp", "rocky_wide", "rocky_layers", "chipped", "rocky", "strata"):
    query(f"filter_{_name}")(_run(_name, _OR, 6))


# ------------------------------------------------------------------ masks from fields

_KEYS = masks.FIELD_SOURCES


@query("mask_fields", with_grid("SELECT i, j, " + ", ".join(f"coalesce(max(CASE WHEN n = {k} THEN v END), 0.0) AS {name}" for k, name in enumerate(_KEYS[:-1])) + f", 1.0::DOUBLE AS {_KEYS[-1]} FROM (SELECT g.i, g.j, s.range AS n, CASE WHEN (g.i + g.j + s.range) % 3 > 0 THEN g.h / (20.0::DOUBLE * (s.range + 1)) - 0.1 END AS v FROM g, range({len(_KEYS) - 1}) s) t GROUP BY i, j"))
def mask_fields(spark, sf_dir):
    g = grid(spark, sf_dir)
    n = F.array(*(F.struct(F.lit(k).alias("n"), F.lit(name).alias("field")) for k, name in enumerate(_KEYS[:-1])))
    fields = g.withColumn("f", F.explode(n)).where("(i + j + f.n) % 3 > 0").select("i", "j", "f.field", (F.col("h") / (20.0 * (F.col("f.n") + 1)) - 0.1).alias("value"))
    return masks.field_masks(g, fields).select("i", "j", *_KEYS)


# ------------------------------------------------------------------ SQL of queries that catalog has without

_CHANNELS = _PATHS + """, a AS (SELECT i, j, count(*) AS area FROM w GROUP BY i, j), net AS (SELECT fl.i, fl.j, fl.ri, fl.rj FROM fl JOIN a USING (i, j) WHERE area >= 3),
s AS (SELECT 0 AS it, i, j, ri, rj, 1 AS o FROM net UNION ALL
  SELECT it + 1, i, j, ri, rj, o FROM (SELECT t.it, n.i, n.j, n.ri, n.rj, CASE WHEN d.top IS NULL THEN 1 WHEN d.ties > 1 THEN d.top + 1 ELSE d.top END AS o FROM net n CROSS JOIN (SELECT max(it) AS it FROM s) t
    LEFT JOIN (SELECT ri, rj, max(o) AS top, count(*) FILTER (WHERE o = most) AS ties FROM (SELECT ri, rj, o, max(o) OVER (PARTITION BY ri, rj) AS most FROM s) q GROUP BY ri, rj) d ON d.ri = n.i AND d.rj = n.j WHERE t.it < 40) u)"""
ORACLE_SQL["strahler_order"] = f"{_CHANNELS} SELECT fl.i, fl.j, CAST(coalesce(s.o, 0) AS INT) AS strahler FROM fl LEFT JOIN s ON s.i = fl.i AND s.j = fl.j AND s.it = 40"


# ------------------------------------------------------------------ polygons, valleys, tiles of a rectangle

_POINTS = ((0.2, 0.2), (0.8, 0.3), (0.7, 0.75), (0.3, 0.6))
_EDGES = list(zip(_POINTS, _POINTS[1:] + _POINTS[:1]))


def _far_sql() -> str:
    def one(a, b) -> str:
        (ax, az), (bx, bz) = ((u * 320.0, v * 320.0) for u, v in (a, b))
        dx, dz = bx - ax, bz - az
        t = clamp_sql(f"((x - {ax!r}::DOUBLE) * {dx!r}::DOUBLE + (z - {az!r}::DOUBLE) * {dz!r}::DOUBLE) / {dx * dx + dz * dz!r}::DOUBLE")
        return f"sqrt((x - ({ax!r}::DOUBLE + {t} * {dx!r}::DOUBLE)) ** 2 + (z - ({az!r}::DOUBLE + {t} * {dz!r}::DOUBLE)) ** 2)"

    return f"least({', '.join(one(*e) for e in _EDGES)})"


def _left_sql() -> str:
    """Inside a convex polygon whose corners go around one way: on one side of every edge."""
    return " AND ".join(f"({b[0] - a[0]!r}::DOUBLE) * (z / 320 - {a[1]!r}::DOUBLE) - ({b[1] - a[1]!r}::DOUBLE) * (x / 320 - {a[0]!r}::DOUBLE) > 0" for a, b in _EDGES)


@query("polygon_height", with_grid(f"""SELECT i, j, round(CASE WHEN w <= 1e-4 THEN h ELSE h * (1 - w) + (h + 12) * w END, 7) + 0.0 AS raised, round(CASE WHEN w <= 1e-4 THEN h ELSE h * (1 - w) + (h - 12) * w END, 7) + 0.0 AS carved, round(CASE WHEN w <= 1e-4 THEN h ELSE h * (1 - w) + 12 * w END, 7) + 0.0 AS made
  FROM (SELECT *, CASE WHEN {_left_sql()} THEN 1 ELSE t * t * (3 - 2 * t) END AS w FROM (SELECT *, {clamp_sql(f'1 - {_far_sql()} / 32.0')} AS t FROM gs) a) b""", f"{_N4}, {_SLOPED}"))
def polygon_height(spark, sf_dir):
    g = grid(spark, sf_dir)
    made = {k: pointwise.polygon_height(g, M, _POINTS, 12.0, 0.1, **o).withColumnRenamed("h", k) for k, o in {"raised": {}, "carved": {"carve": True}, "made": {"set_elevation": True}}.items()}
    return rounded(made["raised"].join(made["carved"], ["i", "j"]).join(made["made"], ["i", "j"]), digits=7)


@query("valley_mask", _PATHS + f", a AS (SELECT i, j, count(*) AS area FROM w0 GROUP BY i, j), {_N4}, {_P}, {_RV} SELECT i, j, CASE WHEN area >= 4 OR valley > 0.65 THEN 1.0 ELSE 0.0 END::DOUBLE AS valley FROM a JOIN rv USING (i, j)".replace("w0", "paths"))
def valley_mask(spark, sf_dir):
    d = hydrology.accumulate(rock.ridge_valley(grid(spark, sf_dir), M, 12.0))
    return d.select("i", "j", F.when((F.col("area") >= 4.0) | (F.col("valley") > 0.65), 1.0).otherwise(0.0).alias("valley"))


ORACLE_SQL["valley_mask"] = ORACLE_SQL["valley_mask"].replace(", w AS (SELECT i AS si", ", paths AS (SELECT i AS si", 1).replace("FROM w JOIN fl ON fl.i = w.i AND fl.j = w.j", "FROM paths w JOIN fl ON fl.i = w.i AND fl.j = w.j")

_RECTS = ((0.1, 0.2, 0.5, 0.4), (0.0, 0.0, 1.0, 1.0), (0.74, 0.99, 0.74, 1.5))


@query("tiles_of_rect", f"""SELECT CAST(r AS INT) AS rect, CAST(x.range AS INT) AS tx, CAST(z.range AS INT) AS tz FROM (VALUES {', '.join(f'({k}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)' for k, (a, b, c, d) in enumerate(_RECTS))}) v(r, a, b, c, d), range(4) x, range(4) z
  WHERE x.range BETWEEN floor(least(floor(a * 32), 31) / 8) AND floor((greatest(least(ceil(least(c, 1) * 32), 32), least(floor(a * 32), 31) + 1) - 1) / 8) AND z.range BETWEEN floor(least(floor(b * 32), 31) / 8) AND floor((greatest(least(ceil(least(d, 1) * 32), 32), least(floor(b * 32), 31) + 1) - 1) / 8)""")
def tiles_of_rect(spark, sf_dir):
    return spark.createDataFrame([(k, *t) for k, r in enumerate(_RECTS) for t in combine.tiles_of_rect(M, *r)], "rect int, tx int, tz int")
