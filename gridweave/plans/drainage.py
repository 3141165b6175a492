"""Queries of split drainage, lakes, river cutting and climate, with their SQL; registered beside those of catalog."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from ..operators import climate, routing
from ..operators.hydrology import D8
from .base import LAYER, M, grid, layer, rounded, with_grid
from .catalog import _DIRS, _FLOW, _N4, ORACLE_SQL, clamp_sql, query

_FILL = """up AS (SELECT i, j, h AS v FROM g WHERE i = 0 OR j = 0 OR i = 31 OR j = 31 UNION SELECT g.i, g.j, greatest(g.h, up.v) FROM up JOIN g ON abs(g.i - up.i) <= 1 AND abs(g.j - up.j) <= 1 AND (g.i <> up.i OR g.j <> up.j) AND g.i BETWEEN 1 AND 30 AND g.j BETWEEN 1 AND 30),
  fd AS (SELECT i, j, min(v) AS h FROM up GROUP BY i, j)"""


def _recursive(more: str, body: str) -> str:
    return f"WITH RECURSIVE {with_grid('', more).strip().removeprefix('WITH ')} {body}"


def _flow_over(table: str, tag: str) -> str:
    """The D8 relations of another table, their names with a tag."""
    return re.sub(r"\b(e|f|fl)\b", rf"\1{tag}", re.sub(r"\bg\b", table, _FLOW))


def _area(tag: str) -> str:
    return f"w{tag} AS (SELECT i, j, 1.0::DOUBLE AS w FROM fl{tag} UNION ALL SELECT fl{tag}.ri, fl{tag}.rj, sum(w) FROM w{tag} JOIN fl{tag} USING (i, j) WHERE fl{tag}.ri IS NOT NULL GROUP BY 1, 2), a{tag} AS (SELECT i, j, sum(w) AS area FROM w{tag} GROUP BY 1, 2)"


# ------------------------------------------------------------------ D-infinity

_FACETS = ", ".join(f"({k}, {ax}, {az}, {bx}, {bz})" for k, ((ax, az), (bx, bz)) in enumerate(zip(D8, D8[1:] + D8[:1], strict=True)))
_DINF = f"""fa AS (SELECT g.i, g.j, t.k, t.ax, t.az, t.bx, t.bz, a.h - g.h AS za, b.h - g.h AS zb, sqrt(CAST(t.ax * t.ax + t.az * t.az AS DOUBLE)) * 10 AS la, sqrt(CAST(t.bx * t.bx + t.bz * t.bz AS DOUBLE)) * 10 AS lb, CAST((t.ax * t.bz - t.az * t.bx) * 100 AS DOUBLE) AS det
  FROM g, (VALUES {_FACETS}) t(k, ax, az, bx, bz) JOIN g a ON a.i = g.i + t.ax AND a.j = g.j + t.az JOIN g b ON b.i = g.i + t.bx AND b.j = g.j + t.bz),
fb AS (SELECT *, (za * bz * 10 - zb * az * 10) / det AS gx, (zb * ax * 10 - za * bx * 10) / det AS gz FROM fa),
fc AS (SELECT *, (gz * bx * 10 - gx * bz * 10) / det AS ca, (gx * az * 10 - gz * ax * 10) / det AS cb FROM fb),
fw AS (SELECT *, CASE WHEN za < 0 THEN greatest(ca, 0) * la ELSE 0 END AS wa, CASE WHEN zb < 0 THEN greatest(cb, 0) * lb ELSE 0 END AS wb FROM fc),
fs AS (SELECT *, CASE WHEN ca >= -1e-6 AND cb >= -1e-6 AND wa + wb > {routing.LEAST!r}::DOUBLE THEN sqrt(gx * gx + gz * gz) ELSE greatest(-za / la, -zb / lb, 0) END AS s,
  CASE WHEN ca >= -1e-6 AND cb >= -1e-6 AND wa + wb > {routing.LEAST!r}::DOUBLE THEN wa / (wa + wb) WHEN greatest(-za / la, 0) >= greatest(-zb / lb, 0) THEN 1.0 ELSE 0.0 END::DOUBLE AS pa FROM fw),
best AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY round(s, 9) DESC, k) AS n FROM fs WHERE s > 0),
de AS (SELECT i, j, i + ax AS ri, j + az AS rj, pa AS fraction FROM best WHERE n = 1 AND pa > 0 UNION ALL SELECT i, j, i + bx, j + bz, 1 - pa FROM best WHERE n = 1 AND pa < 1)"""


@query("flow_direction_dinf", with_grid("SELECT i, j, CAST(ri AS INT) AS ri, CAST(rj AS INT) AS rj, round(fraction, 8) + 0.0 AS fraction FROM de", _DINF))
def flow_direction_dinf(spark, sf_dir):
    return rounded(routing.dinf_edges(grid(spark, sf_dir), M), digits=8)


@query("accumulation_dinf", _recursive(f"{_DINF}, w AS (SELECT i, j, 1.0::DOUBLE AS w FROM g UNION ALL SELECT CAST(de.ri AS INT), CAST(de.rj AS INT), sum(w.w * de.fraction) FROM w JOIN de USING (i, j) GROUP BY 1, 2)", "SELECT i, j, round(sum(w), 7) + 0.0 AS area FROM w GROUP BY i, j"))
def accumulation_dinf(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(routing.drain(g, routing.dinf_edges(g, M)).select("i", "j", "area"), digits=7)


# ------------------------------------------------------------------ basins that stay

_DEEP, _CELLS = 3.0, 3


@query("preserve_basins", _recursive(f"""{_FILL}, pc AS (SELECT g.i, g.j, g.h, fd.h AS v FROM g JOIN fd USING (i, j) WHERE fd.h - g.h > {routing.PIT}),
  lb AS (SELECT i, j, j * 32 + i AS pit FROM pc UNION SELECT p.i, p.j, lb.pit FROM lb JOIN pc p ON abs(p.i - lb.i) <= 1 AND abs(p.j - lb.j) <= 1),
  own AS (SELECT i, j, min(pit) AS pit FROM lb GROUP BY 1, 2), sz AS (SELECT own.pit, max(pc.v - pc.h) AS deep, count(*) AS n FROM own JOIN pc USING (i, j) GROUP BY 1),
  st AS (SELECT pc.i, pc.j, pc.v, deep >= {_DEEP} AND n >= {_CELLS} AS stays FROM pc JOIN own USING (i, j) JOIN sz USING (pit))""",
  "SELECT g.i, g.j, round(CASE WHEN NOT stays THEN v ELSE h END, 8) + 0.0 AS h, round(CASE WHEN NOT stays THEN v - h ELSE 0 END, 8) + 0.0 AS raised, CASE WHEN stays THEN 1.0 ELSE 0.0 END::DOUBLE AS lake FROM g LEFT JOIN st USING (i, j)"))
def preserve_basins(spark, sf_dir):
    return rounded(routing.preserve_basins(grid(spark, sf_dir), M, _DEEP, _CELLS), digits=8)


# ------------------------------------------------------------------ cutting

def _slopes(table: str, name: str) -> str:
    return f"{name} AS (SELECT s.i, s.j, greatest(max((s.h - o.h) / CASE WHEN d.di <> 0 AND d.dj <> 0 THEN sqrt(2.0) ELSE 1 END), 1e-6) AS s FROM {table} s, (VALUES {_DIRS}) d(k, di, dj), {table} o WHERE o.i = s.i + d.di AND o.j = s.j + d.dj GROUP BY 1, 2)"


def _cut(ground: str, tag: str, name: str, incision: str) -> str:
    nxt = f"greatest(h - least(0.002 * (greatest(a{tag}.area * 100, 100)) ** 0.5 * s * (1 - w) * 2, s * 2, 50) + 0.01, 5)"
    return f"{name} AS (SELECT i, j, {nxt} AS h, {incision} + greatest(h - {nxt}, 0) AS incision, a{tag}.area FROM {ground} JOIN a{tag} USING (i, j) JOIN s{tag} USING (i, j) JOIN k USING (i, j))"


@query("stream_power", _recursive(f"{LAYER.strip()}, {_FILL}, {_flow_over('fd', 'x')}, {_area('x')}, {_slopes('fd', 'sx')}, {_cut('g', 'x', 'p1', '0')}, {_flow_over('p1', 'y')}, {_area('y')}, {_slopes('p1', 'sy')}, {_cut('p1', 'y', 'p2', 'incision')}", "SELECT i, j, round(h, 7) + 0.0 AS h, round(incision, 7) + 0.0 AS incision, area FROM p2"))
def stream_power(spark, sf_dir):
    g = grid(spark, sf_dir)
    g = g.withColumn("w", ((F.col("i") * 7 + F.col("j") * 13) % 11) / 10.0)
    out = routing.stream_power(g, M, 0.002, 0.5, 1.0, 2.0, 2, "w", uplift=0.01, base=5.0)
    return rounded(out.select("i", "j", "h", "incision", "area"), "h", "incision", digits=7)


@query("river_carve", _recursive(f"""{_FILL}, {_flow_over('fd', 'x')}, {_area('x')}, ch AS (SELECT i, j, least(greatest(sqrt(area / 6), 1), 4) AS s FROM ax WHERE area >= 6),
  cu AS (SELECT g.i, g.j, sum(0.8 * sqrt(s) * b) AS cut, max(least(b * sqrt(s) * 0.85, 1)) AS wet FROM (SELECT g.i, g.j, s, exp(-0.5 * (sqrt(CAST((g.i - ch.i) ** 2 + (g.j - ch.j) ** 2 AS DOUBLE)) / (1.2 * s * 0.45)) ** 2) AS b FROM ch JOIN g ON sqrt(CAST((g.i - ch.i) ** 2 + (g.j - ch.j) ** 2 AS DOUBLE)) <= 1.2 * s * 1.375) g GROUP BY 1, 2)""",
  "SELECT g.i, g.j, round(h - coalesce(cut, 0), 7) + 0.0 AS h, round(coalesce(wet, 0), 7) + 0.0 AS wetness, round(area / (SELECT max(area) FROM ax), 9) + 0.0 AS accumulation FROM g JOIN ax USING (i, j) LEFT JOIN cu USING (i, j)"))
def river_carve(spark, sf_dir):
    return rounded(rounded(routing.carve_rivers(grid(spark, sf_dir), M, 6.0, 1.2, 0.8, 0.5), "h", "wetness", digits=7), "accumulation")


# ------------------------------------------------------------------ climate

def _flood(seed: str, name: str, out: str) -> str:
    """Jump flooding over g in SQL: the nearest seed that rounds at steps 16 to 1 pass on, which may miss the nearest of all."""
    ways = [(0, 0), *((di, dj) for dj in (-1, 0, 1) for di in (-1, 0, 1) if (di, dj) != (0, 0))]
    near, last = ", ".join(f"({r}, {di}, {dj})" for r, (di, dj) in enumerate(ways)), f"{name}j0"
    stages = [f"{last} AS (SELECT i, j, CASE WHEN {seed} THEN i END AS x, CASE WHEN {seed} THEN j END AS y FROM g)"]
    for step in (16, 8, 4, 2, 1):
        stages.append(f"""{name}j{step} AS (SELECT i, j, p.x, p.y FROM g LEFT JOIN (SELECT c.i, c.j, arg_min({{'x': o.x, 'y': o.y}}, ((c.i - o.x) ** 2 + (c.j - o.y) ** 2) * 16 + d.r) AS p FROM {last} c, (VALUES {near}) d(r, di, dj), {last} o
          WHERE o.i = c.i + d.di * {step} AND o.j = c.j + d.dj * {step} AND o.x IS NOT NULL GROUP BY 1, 2) q USING (i, j))""")
        last = f"{name}j{step}"
    return ", ".join([*stages, f"{name} AS (SELECT i, j, coalesce(least(sqrt(CAST((i - x) ** 2 + (j - y) ** 2 AS DOUBLE)) / sqrt(2048.0::DOUBLE), 1), 1.0) AS {out} FROM {last})"])


_C = climate.Climate(sea_level=25.0, snow_line=40.0, wind_dir_deg=60.0)
_SIN, _COS, _DIAG = f"{math.sin(math.radians(60.0))!r}::DOUBLE", f"{math.cos(math.radians(60.0))!r}::DOUBLE", f"{math.hypot(320.0, 320.0)!r}::DOUBLE"
_CLIMATE = f"""c0 AS (SELECT n.i, n.j, n.h, y.h / 50 AS wet, (hr - hl) / 20 AS gx, (hu - hd) / 20 AS gz FROM n JOIN y USING (i, j)),
{_flood('h <= 25', 'c1', 'far')},
c2 AS (SELECT *, {clamp_sql('degrees(atan(sqrt(gx * gx + gz * gz))) / 90')} AS slope, {clamp_sql('1 - abs(CASE WHEN atan2(gz, -gx) < 0 THEN degrees(atan2(gz, -gx)) + 360 ELSE degrees(atan2(gz, -gx)) END - 180) / 180')} AS warm,
  {clamp_sql('0.72 - 0.35 * 0.35 - (j / 31.0::DOUBLE - 0.5) * 2 * 0.18 - 0.0012 * greatest(h, 0)')} AS base, {clamp_sql(f'(gx * {_SIN} + gz * {_COS}) * 2')} AS up, {clamp_sql(f'-(gx * {_SIN} + gz * {_COS}) * 2')} AS lee,
  {clamp_sql(f'0.4 * 0.35 + exp(-far * {_DIAG} / 120) * 0.45 + wet * 0.35')} AS damp FROM c0 JOIN c1 USING (i, j)),
c3 AS (SELECT *, {clamp_sql('base * 0.85 + (1 - slope * 0.35) * (0.65 + 0.35 * warm) * 0.15 * greatest(base, 0.15)')} AS temperature, {clamp_sql('0.55 * damp * (1 + 0.85 * up) * greatest(1 - 0.7 * lee, 0.05)')} AS rainfall FROM c2),
cl AS (SELECT i, j, h, wet, temperature, rainfall, {clamp_sql('damp * 0.55 + rainfall * 0.45')} AS humidity, 1 - {clamp_sql('damp * 0.55 + rainfall * 0.45')} AS aridity,
  {clamp_sql('greatest(greatest(0.28 - temperature, 0) / 0.28, CASE WHEN h >= 40 THEN ' + clamp_sql('(h - 40) / 21') + ' ELSE 0 END) * (0.4 + 0.6 * rainfall)')} AS snow,
  {clamp_sql('rainfall * 0.45 + wet * 0.4 - slope * 0.55')} AS soil_moisture, {clamp_sql('up * (0.4 + 0.6 * slope)')} AS wind_exposure, slope FROM c3)"""
_BANDS = ((1, {"rainfall": (0.0, 0.2)}), (2, {"temperature": (0.4, 1.0), "rainfall": (0.15, 0.5)}), (5, {"soil_moisture": (0.05, 1.0), "h": (-1e9, 45.0)}), (7, {"snow": (0.2, 1.0), "wet": (0.3, 1.0)}))
_BIOME = "CASE " + " ".join("WHEN " + " AND ".join(f"{c} BETWEEN {a!r} AND {b!r}" for c, (a, b) in ranges.items()) + f" THEN {n / 16.0!r}" for n, ranges in reversed(_BANDS)) + " ELSE 0.0 END::DOUBLE"


def _climate(spark, sf_dir):
    wet = layer(spark, sf_dir).select("i", "j", (F.col("h") / 50).alias("wet"))
    return climate.bake(grid(spark, sf_dir).join(wet, ["i", "j"]), M, _C, "wet")


@query("climate_fields", with_grid("SELECT i, j, " + ", ".join(f"round({f}, 7) + 0.0 AS {f}" for f in climate.FIELDS) + " FROM cl", f"{LAYER}, {_N4}, {_CLIMATE}"))
def climate_fields(spark, sf_dir):
    return rounded(_climate(spark, sf_dir).select("i", "j", *climate.FIELDS), digits=7)


@query("climate_biomes", with_grid(f"SELECT i, j, {_BIOME} AS biome FROM cl", f"{LAYER}, {_N4}, {_CLIMATE}"))
def climate_biomes(spark, sf_dir):
    return climate.biomes(_climate(spark, sf_dir), _BANDS).select("i", "j", "biome")


@query("plant_suitability", with_grid(f"SELECT i, j, CASE WHEN slope * 90 BETWEEN 5 AND 40 AND {_BIOME} * 16 = 5 THEN least(wet, 1) ELSE 0 END AS suitability FROM cl", f"{LAYER}, {_N4}, {_CLIMATE}"))
def plant_suitability(spark, sf_dir):
    d = climate.biomes(_climate(spark, sf_dir), _BANDS)
    return climate.plant_suitability(d, M, 5.0, 40.0, 5, "wet").select("i", "j", "suitability")


#: The operation is jump flooding; the nearest seed of all is not always what it finds.
ORACLE_SQL["seed_distance"] = with_grid("SELECT i, j, round(far, 9) + 0.0 AS distance FROM sd", _flood("h > 60", "sd", "far"))
