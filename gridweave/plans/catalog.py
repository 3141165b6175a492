"""The queries of the grid operators and the SQL that they are held against."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blend as blends
from ..functions import masks
from ..functions import math as fm
from ..functions import noise
from ..operators import combine, derivatives, filters, hydrology, pointwise, reduce, stencil
from ..sources import grid as source
from ..sources import raster
from ..streaming import edits
from . import stack
from .base import GRID, LAYER, M, grid, layer, mask, rounded, sql_rounded, with_grid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "grid_terrain_analysis"

K9 = "round({0}, 9) + 0.0"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def clamp_sql(x: str, lo: float = 0.0, hi: float = 1.0) -> str:
    return f"least(greatest({x}, {lo!r}::DOUBLE), {hi!r}::DOUBLE)"


# ------------------------------------------------------------------ sources

_XZ = "(i + 0.5) * 10.0::DOUBLE AS x, (j + 0.5) * 10.0::DOUBLE AS z"


@query(
    "source_flat_ramp",
    with_grid(sql_rounded(f"SELECT i, j, 7.5::DOUBLE AS flat, 5.0 + 90.0 * {clamp_sql('((i + 0.5) / 32) * cos(0.6) + ((j + 0.5) / 32) * sin(0.6)')} AS ramp FROM c", "i, j, flat", "ramp")),
)
def source_flat_ramp(spark, sf_dir):
    c = source.flat(source.cells(spark, M), 7.5).withColumnRenamed("h", "flat")
    return rounded(source.ramp(c, M, 0.6, 5.0, 95.0).select("i", "j", "flat", F.col("h").alias("ramp")))


@query("grid_min_max", with_grid("SELECT min(h) AS lo, max(h) AS hi FROM g"))
def grid_min_max(spark, sf_dir):
    return reduce.min_max(grid(spark, sf_dir))


@query(
    "source_fixtures",
    with_grid("""SELECT i, j, CAST(31 - i AS DOUBLE) AS plane, round(abs(i - 15.5) + (31 - j) * 0.15::DOUBLE, 9) + 0.0 AS valley,
      round(greatest(0.0, 1 - r / sqrt(2 * 15.5 * 15.5)) * 50.0, 9) + 0.0 AS cone, round(2 * r, 9) + 0.0 AS basin,
      round(abs((i % 16) / 16.0::DOUBLE - 0.5) * 20 + CASE WHEN i BETWEEN 15 AND 17 THEN 30 ELSE 0 END + abs(j - 15.5) * 0.05 + (1 - abs(i - 16) / 16.0::DOUBLE) * 0.01, 9) + 0.0 AS two_basins,
      31.0::DOUBLE - i - CASE WHEN i = 16 AND j = 16 THEN 12 WHEN i BETWEEN 14 AND 18 AND j BETWEEN 14 AND 18 THEN 8 ELSE 0 END AS pit
      FROM (SELECT *, sqrt((i - 15.5) * (i - 15.5) + (j - 15.5) * (j - 15.5))::DOUBLE AS r FROM c) t"""),
)
def source_fixtures(spark, sf_dir):
    from ..sources import fixtures

    return rounded(fixtures.all_of(source.cells(spark, M), M))


# ------------------------------------------------------------------ noise

def _hash_sql(x: str) -> str:
    """The 32-bit avalanche with one 128-bit product for each step."""
    a = f"list_transform([{x}], lambda v: xor(v, v >> 16))"
    b = f"list_transform({a}, lambda v: CAST((v::HUGEINT * 2146121005) % 4294967296 AS BIGINT))"
    c = f"list_transform({b}, lambda v: xor(v, v >> 15))"
    d = f"list_transform({c}, lambda v: CAST((v::HUGEINT * 2221713035) % 4294967296 AS BIGINT))"
    return f"list_transform({d}, lambda v: xor(v, v >> 16))[1]"


def _lattice_sql(ix: str, iz: str, seed: int) -> str:
    first = _hash_sql(f"xor({seed}::BIGINT, ({ix})::BIGINT & 4294967295)")
    return _hash_sql(f"xor({first}, ({iz})::BIGINT & 4294967295)")


def _noise_cte(name: str, source_sql: str, x: str, z: str, seed: int, keep: str) -> str:
    """A stage with corner hashes h00 .. h11 and fractions fx, fz of samples at (x, z)."""
    return f"""{name}a AS (SELECT {keep}, {x} AS px, {z} AS pz, CAST(floor({x}) AS BIGINT) AS ix, CAST(floor({z}) AS BIGINT) AS iz FROM {source_sql}),
{name} AS (SELECT {keep}, px - ix AS fx, pz - iz AS fz, {_lattice_sql('ix', 'iz', seed)} AS h00, {_lattice_sql('ix + 1', 'iz', seed)} AS h10,
  {_lattice_sql('ix', 'iz + 1', seed)} AS h01, {_lattice_sql('ix + 1', 'iz + 1', seed)} AS h11 FROM {name}a)"""


def _grad_sql(h: str, x: str, z: str) -> str:
    return f"CASE {h} & 3 WHEN 0 THEN ({x}) + ({z}) WHEN 1 THEN ({z}) - ({x}) WHEN 2 THEN ({x}) - ({z}) ELSE -({x}) - ({z}) END"


_FU, _FV = "(fx * fx * fx * (fx * (fx * 6 - 15) + 10))", "(fz * fz * fz * (fz * (fz * 6 - 15) + 10))"
_PERLIN = f"""(({_grad_sql('h00', 'fx', 'fz')}) * (1 - {_FU}) * (1 - {_FV}) + ({_grad_sql('h10', 'fx - 1', 'fz')}) * {_FU} * (1 - {_FV})
  + ({_grad_sql('h01', 'fx', 'fz - 1')}) * (1 - {_FU}) * {_FV} + ({_grad_sql('h11', 'fx - 1', 'fz - 1')}) * {_FU} * {_FV}) * sqrt(2.0)"""
_VALUE = f"(((h00 * (1 - {_FU}) + h10 * {_FU}) * (1 - {_FV}) + (h01 * (1 - {_FU}) + h11 * {_FU}) * {_FV}) / 4294967295.0::DOUBLE * 2 - 1)"


@query("noise_value_perlin", f"WITH c AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j FROM range(32) a, range(32) b), s AS (SELECT i, j, {_XZ} FROM c), {_noise_cte('n', 's', '(x - 77.0::DOUBLE) * 0.037::DOUBLE', '(z - 77.0::DOUBLE) * 0.037::DOUBLE', 42, 'i, j')} SELECT i, j, round({_VALUE}, 9) + 0.0 AS value, round({_PERLIN}, 9) + 0.0 AS perlin FROM n")
def noise_value_perlin(spark, sf_dir):
    let = noise.Let(source.with_world(source.cells(spark, M), M))
    at = [((F.col("x") - 77.0) * 0.037, (F.col("z") - 77.0) * 0.037, 42)]
    (v,), (p,) = noise.value(let, at), noise.perlin(let, at)
    return rounded(let.done(value=v, perlin=p).drop("x", "z"))


def _octaves_sql(expr: str, seed: int, freq: float, octaves: int, stride: int, lacunarity: float, x: str = "x", z: str = "z", base: str = "s") -> tuple[str, str]:
    """Chained stages that add columns o0, o1, ... of one noise expression to the base; (CTEs, last name)."""
    ctes, last, keep = [], base, "i, j, x, z"
    for o in range(octaves):
        f = freq * lacunarity**o
        ctes.append(_noise_cte(f"n{o}", last, f"({x}) * {f!r}::DOUBLE", f"({z}) * {f!r}::DOUBLE", seed + o * stride, keep))
        ctes.append(f"m{o} AS (SELECT {keep}, {expr} AS o{o} FROM n{o})")
        last, keep = f"m{o}", f"{keep}, o{o}"
    return ", ".join(ctes), last


def _powers(f: float, r: float, n: int) -> list[float]:
    out = []
    for _ in range(n):
        out.append(f)
        f *= r
    return out


_CELLS = f"c AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j FROM range(32) a, range(32) b), s AS (SELECT i, j, {_XZ} FROM c)"


def _fbm_sql(expr: str) -> str:
    ctes, last = _octaves_sql(expr, 9, 0.02, 3, 1013, 2.0)
    return f"WITH {_CELLS}, {ctes} SELECT i, j, round(({clamp_sql('((o0 + o1 * 0.5 + o2 * 0.25) / 1.75 + 1) / 2')} * 2 - 1) * 120, 9) + 0.0 AS h FROM {last}"


_P3 = noise.Fractal(seed=9, frequency=0.02, octaves=3)


def _fractal_query(kind: str):
    def run(spark, sf_dir):
        let = noise.Let(source.with_world(source.cells(spark, M), M))
        h = noise.fbm(let, kind, F.col("x"), F.col("z"), _P3)
        return rounded(let.done(h=h).drop("x", "z"))

    return run


query("noise_fbm_perlin", _fbm_sql(_PERLIN))(_fractal_query("perlin"))
query("noise_fbm_value", _fbm_sql(_VALUE))(_fractal_query("value"))


def _ridged_sql() -> str:
    ctes, last = _octaves_sql(_PERLIN, 9, 0.02, 3, 9173, 2.0)
    r = lambda o: clamp_sql(f"1 - abs({o})")
    return f"""WITH {_CELLS}, {ctes}, r0 AS (SELECT *, {r('o0')} * {r('o0')} AS s0 FROM {last}),
      r1 AS (SELECT *, {r('o1')} * {r('o1')} * {clamp_sql('s0 * 2')} AS s1 FROM r0), r2 AS (SELECT *, {r('o2')} * {r('o2')} * {clamp_sql('s1 * 2')} AS s2 FROM r1)
      SELECT i, j, round({clamp_sql('(s0 + s1 * 0.5 + s2 * 0.25) / 1.75')} * 120, 9) + 0.0 AS h FROM r2"""


@query("noise_ridged", _ridged_sql())
def noise_ridged(spark, sf_dir):
    let = noise.Let(source.with_world(source.cells(spark, M), M))
    return rounded(let.done(h=noise.ridged(let, "perlin", F.col("x"), F.col("z"), _P3)).drop("x", "z"))


def _billow_sql() -> str:
    ctes, last = _octaves_sql(_PERLIN, 9, 0.02, 3, 6151, 2.0)
    return f"WITH {_CELLS}, {ctes} SELECT i, j, round({clamp_sql('(abs(o0) + abs(o1) * 0.5 + abs(o2) * 0.25) / 1.75')}, 9) + 0.0 AS h FROM {last}"


@query("noise_billow", _billow_sql())
def noise_billow(spark, sf_dir):
    let = noise.Let(source.with_world(source.cells(spark, M), M))
    return rounded(let.done(h=noise.billow(let, F.col("x"), F.col("z"), _P3)).drop("x", "z"))


_WARP = f"""WITH {_CELLS}, {_noise_cte('a', 's', 'x * 0.011::DOUBLE', 'z * 0.011::DOUBLE', 9, 'i, j, x, z')}, b AS (SELECT i, j, x, z, {_PERLIN} * 40 AS wx FROM a),
{_noise_cte('d', 'b', 'x * 0.011::DOUBLE + 19.1::DOUBLE', 'z * 0.011::DOUBLE + 7.3::DOUBLE', 10, 'i, j, x, z, wx')}, e AS (SELECT i, j, x + wx AS x, z + {_PERLIN} * 40 AS z FROM d), """


def _warp_sql() -> str:
    ctes, last = _octaves_sql(_PERLIN, 9, 0.02, 3, 1013, 2.0, base="e")
    return f"{_WARP}{ctes} SELECT i, j, round(({clamp_sql('((o0 + o1 * 0.5 + o2 * 0.25) / 1.75 + 1) / 2')} * 2 - 1) * 120, 8) + 0.0 AS h FROM {last}"


@query("noise_domain_warp", _warp_sql())
def noise_domain_warp(spark, sf_dir):
    let = noise.Let(source.with_world(source.cells(spark, M), M))
    return rounded(let.done(h=noise.domain_warp(let, F.col("x"), F.col("z"), _P3, 40.0, 0.011)).drop("x", "z"), digits=8)


def _worley_sql() -> str:
    pts = f"""p AS (SELECT i, j, x * 0.031::DOUBLE AS px, z * 0.031::DOUBLE AS pz, CAST(floor(x * 0.031::DOUBLE) AS BIGINT) + da.range AS cx, CAST(floor(z * 0.031::DOUBLE) AS BIGINT) + db.range AS cz FROM s, range(-1, 2) da, range(-1, 2) db),
    q AS (SELECT i, j, px - (cx + {_lattice_sql('cx', 'cz', 5)} / 4294967295.0::DOUBLE) AS dx, pz - (cz + {_lattice_sql('cx', 'cz', 5 ^ noise.SECOND_SEED)} / 4294967295.0::DOUBLE) AS dz FROM p)"""
    two = lambda d: f"list_sort(list({d}))"
    return f"""WITH {_CELLS}, {pts}, r AS (SELECT i, j, {two('sqrt(dx * dx + dz * dz)')} AS e, {two('abs(dx) + abs(dz)')} AS m, {two('greatest(abs(dx), abs(dz))')} AS k FROM q GROUP BY i, j)
    SELECT i, j, round(e[1], 9) + 0.0 AS f1, round(e[2], 9) + 0.0 AS f2, round(e[2] - e[1], 9) + 0.0 AS f2_f1, round(m[1], 9) + 0.0 AS manhattan, round(k[1], 9) + 0.0 AS chebyshev FROM r"""


@query("noise_worley", _worley_sql())
def noise_worley(spark, sf_dir):
    let = noise.Let(source.with_world(source.cells(spark, M), M))
    x, z = F.col("x") * 0.031, F.col("z") * 0.031
    f1, f2 = noise.worley(let, x, z, 5)
    man, _ = noise.worley(let, x, z, 5, "manhattan")
    che, _ = noise.worley(let, x, z, 5, "chebyshev")
    return rounded(let.done(f1=f1, f2=f2, f2_f1=f2 - f1, manhattan=man, chebyshev=che).drop("x", "z"))


_GRAD8 = lambda h, x, z: f"CASE {h} & 7 WHEN 0 THEN {x} + {z} WHEN 1 THEN {z} - {x} WHEN 2 THEN {x} - {z} WHEN 3 THEN -{x} - {z} WHEN 4 THEN {x} WHEN 5 THEN -{x} WHEN 6 THEN {z} ELSE -{z} END"


def _simplex_sql() -> str:
    f, g = f"{noise.SKEW}::DOUBLE", f"{noise.UNSKEW}::DOUBLE"
    part = lambda h, x, z: f"CASE WHEN 0.5 - {x} * {x} - {z} * {z} < 0 THEN 0 ELSE (0.5 - {x} * {x} - {z} * {z}) ** 4 * ({_GRAD8(h, x, z)}) END"
    return f"""WITH {_CELLS}, a AS (SELECT i, j, x * 0.037::DOUBLE AS px, z * 0.037::DOUBLE AS pz FROM s), b AS (SELECT *, floor(px + (px + pz) * {f}) AS ci, floor(pz + (px + pz) * {f}) AS cj FROM a),
    d AS (SELECT *, px - (ci - (ci + cj) * {g}) AS x0, pz - (cj - (ci + cj) * {g}) AS z0 FROM b), e AS (SELECT *, CASE WHEN x0 > z0 THEN 1 ELSE 0 END AS i1, CASE WHEN x0 > z0 THEN 0 ELSE 1 END AS j1 FROM d),
    f AS (SELECT *, x0 - i1 + {g} AS x1, z0 - j1 + {g} AS z1, x0 - 1 + 2 * {g} AS x2, z0 - 1 + 2 * {g} AS z2, {_lattice_sql('ci', 'cj', 42)} AS h0, {_lattice_sql('ci + i1', 'cj + j1', 42)} AS h1, {_lattice_sql('ci + 1', 'cj + 1', 42)} AS h2 FROM e)
    SELECT i, j, round(40 * ({part('h0', 'x0', 'z0')} + {part('h1', 'x1', 'z1')} + {part('h2', 'x2', 'z2')}), 9) + 0.0 AS h FROM f"""


@query("noise_simplex", _simplex_sql())
def noise_simplex(spark, sf_dir):
    let = noise.Let(source.with_world(source.cells(spark, M), M))
    (h,) = noise.simplex(let, [(F.col("x") * 0.037, F.col("z") * 0.037, 42)])
    return rounded(let.done(h=h).drop("x", "z"))


# ------------------------------------------------------------------ blends and composites

_SMIN = lambda a, b: f"(({b}) * (1 - {clamp_sql(f'(({b}) - ({a})) / 8.0 * 0.5 + 0.5')}) + ({a}) * {clamp_sql(f'(({b}) - ({a})) / 8.0 * 0.5 + 0.5')} - 8.0 * {clamp_sql(f'(({b}) - ({a})) / 8.0 * 0.5 + 0.5')} * (1 - {clamp_sql(f'(({b}) - ({a})) / 8.0 * 0.5 + 0.5')}))"
_HB = clamp_sql("(b - a) * 0.05 + 0.5")
_BLEND_SQL = {
    "normal": "b",
    "replace": "b",
    "add": "a + b",
    "subtract": "a - b",
    "multiply": "a * b",
    "min": "CASE WHEN a < b THEN a ELSE b END",
    "max": "CASE WHEN a > b THEN a ELSE b END",
    "interpolate": "b",
    "height_blend": f"a * (1 - {_HB}) + greatest(a, b) * {_HB}",
    "overlay": "CASE WHEN a < 0 THEN 2 * a * b ELSE a + b - a * b / (abs(a) + 1) END",
    "smooth_maximum": f"-{_SMIN('-a', '-b')}",
    "smooth_minimum": _SMIN("a", "b"),
    "smooth_union": f"-{_SMIN('-a', '-b')}",
    "smooth_subtraction": f"-{_SMIN('-a', 'b')}",
}
_BOTH = "ab AS (SELECT g.i, g.j, g.h - 30 AS a, y.h AS b, k.w FROM g JOIN y USING (i, j) JOIN k USING (i, j))"


@query("blend_modes", with_grid("SELECT i, j, " + ", ".join(f"round(a * (1 - {clamp_sql('w * 0.8')}) + ({e}) * {clamp_sql('w * 0.8')}, 11) + 0.0 AS {m}" for m, e in _BLEND_SQL.items()) + " FROM ab", LAYER + ", " + _BOTH))
def blend_modes(spark, sf_dir):
    base = grid(spark, sf_dir).withColumn("h", F.col("h") - 30)
    d = base.join(layer(spark, sf_dir).withColumnRenamed("h", "b"), ["i", "j"]).join(mask(base), ["i", "j"])
    return rounded(d.select("i", "j", *(blends.blend(m, F.col("h"), F.col("b"), 0.8, F.col("w")).alias(m) for m in blends.MODES)), digits=11)


@query("layer_composite", with_grid(f"SELECT i, j, round(a * (1 - {clamp_sql('w * 0.5')}) + (a + b) * {clamp_sql('w * 0.5')}, 9) + 0.0 AS h FROM ab", LAYER + ", " + _BOTH))
def layer_composite(spark, sf_dir):
    base = grid(spark, sf_dir).withColumn("h", F.col("h") - 30)
    return rounded(combine.composite(base, layer(spark, sf_dir), "add", 0.5, mask(base)))


@query("merge_height_delta", with_grid("SELECT i, j, round(a + w * (b - a * 0.5), 9) + 0.0 AS h FROM ab", LAYER + ", " + _BOTH))
def merge_height_delta(spark, sf_dir):
    base = grid(spark, sf_dir).withColumn("h", F.col("h") - 30)
    return rounded(combine.merge_delta(base, base.withColumn("h", F.col("h") * 0.5), layer(spark, sf_dir), mask(base)))


_FIELDS = """p AS (SELECT i, j, 'wet' AS field, h AS value FROM g WHERE (i + j) % 3 <> 0 UNION ALL SELECT i, j, 'sand', h * 2 FROM g WHERE i < 20),
q AS (SELECT i, j, 'wet' AS field, h AS value FROM y WHERE j % 2 = 0 UNION ALL SELECT i, j, 'snow', h + 1 FROM y WHERE i > 5)"""


def _fields(spark, sf_dir):
    g, y = grid(spark, sf_dir), layer(spark, sf_dir)
    row = lambda d, where, name, v: d.where(where).select("i", "j", F.lit(name).alias("field"), v.alias("value"))
    return row(g, "(i + j) % 3 <> 0", "wet", F.col("h")).union(row(g, "i < 20", "sand", F.col("h") * 2)), row(y, "j % 2 = 0", "wet", F.col("h")).union(row(y, "i > 5", "snow", F.col("h") + 1)), mask(g)


@query("merge_fields_masked", with_grid("SELECT i, j, field, round(CASE WHEN q.value IS NULL THEN coalesce(p.value, 0) ELSE coalesce(p.value, 0) * (1 - w) + q.value * w END, 9) + 0.0 AS value FROM p FULL JOIN q USING (i, j, field) JOIN k USING (i, j)", LAYER + ", " + _FIELDS))
def merge_fields_masked(spark, sf_dir):
    return rounded(combine.merge_fields(*_fields(spark, sf_dir)))


@query("fields_override", with_grid("SELECT i, j, field, round(value, 9) + 0.0 AS value FROM q UNION ALL SELECT i, j, field, round(value, 9) + 0.0 FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.i = p.i AND q.j = p.j AND q.field = p.field)", LAYER + ", " + _FIELDS))
def fields_override(spark, sf_dir):
    p, q, _ = _fields(spark, sf_dir)
    return rounded(combine.override_fields(p, q))


# ------------------------------------------------------------------ resampling

_M20 = source.Metrics(20, 12, 320.0, 320.0)
_M48 = source.Metrics(48, 40, 320.0, 320.0)


@query("resample_nearest", with_grid("SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, g.h FROM range(20) a, range(12) b, g WHERE g.i = least(31, floor((a.range + 0.5) / 20 * 32)) AND g.j = least(31, floor((b.range + 0.5) / 12 * 32))"))
def resample_nearest(spark, sf_dir):
    return combine.resample_nearest(grid(spark, sf_dir), M, _M20)


@query("resample_area", with_grid("""SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, round(sum(h * wx * wz) / sum(wx * wz), 10) + 0.0 AS h FROM range(20) a, range(12) b, g,
  LATERAL (SELECT greatest(0, least((g.i + 1) * 20 / 32.0::DOUBLE, a.range + 1) - greatest(g.i * 20 / 32.0::DOUBLE, a.range)) AS wx, greatest(0, least((g.j + 1) * 12 / 32.0::DOUBLE, b.range + 1) - greatest(g.j * 12 / 32.0::DOUBLE, b.range)) AS wz) o WHERE wx * wz > 0 GROUP BY 1, 2"""))
def resample_area(spark, sf_dir):
    return rounded(combine.downsample(grid(spark, sf_dir), M, _M20), digits=10)


@query("resample_bilinear", with_grid("""SELECT u.i, u.j, round(sum(g.h * (CASE WHEN a.range = 1 THEN fu ELSE 1 - fu END) * (CASE WHEN b.range = 1 THEN fv ELSE 1 - fv END)), 8) + 0.0 AS h
  FROM (SELECT CAST(p.range AS INT) AS i, CAST(r.range AS INT) AS j, (p.range + 0.5) / 48 * 32 - 0.5 AS u, (r.range + 0.5) / 40 * 32 - 0.5 AS v, u - floor(u) AS fu, v - floor(v) AS fv FROM range(48) p, range(40) r) u, range(2) a, range(2) b, g
  WHERE g.i = least(31, greatest(0, floor(u.u) + a.range)) AND g.j = least(31, greatest(0, floor(u.v) + b.range)) GROUP BY 1, 2"""))
def resample_bilinear(spark, sf_dir):
    return rounded(combine.upsample(grid(spark, sf_dir), M, _M48), digits=8)


# ------------------------------------------------------------------ stencils

_N4 = """n AS (SELECT g.i, g.j, g.h, l.h AS hl, r.h AS hr, d.h AS hd, u.h AS hu FROM g JOIN g l ON l.i = greatest(g.i - 1, 0) AND l.j = g.j JOIN g r ON r.i = least(g.i + 1, 31) AND r.j = g.j
  JOIN g d ON d.i = g.i AND d.j = greatest(g.j - 1, 0) JOIN g u ON u.i = g.i AND u.j = least(g.j + 1, 31))"""


@query("slope_forward", with_grid("SELECT i, j, round(degrees(atan(sqrt(((hr - h) / 10) ** 2 + ((hu - h) / 10) ** 2))), 8) + 0.0 AS slope FROM n", _N4))
def slope_forward(spark, sf_dir):
    return rounded(stencil.slope_forward(grid(spark, sf_dir), M).select("i", "j", "slope"), digits=8)


@query("slope_central", with_grid(f"SELECT i, j, round({clamp_sql('degrees(atan(sqrt(((hr - hl) / 20) ** 2 + ((hu - hd) / 20) ** 2))) / 90')}, 9) + 0.0 AS slope FROM n", _N4))
def slope_central(spark, sf_dir):
    return rounded(stencil.slope_mask(grid(spark, sf_dir), M).select("i", "j", "slope"))


@query("aspect_window", with_grid(f"""SELECT i, j, round({clamp_sql('1 - abs(CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END) / 60')}, 7) + 0.0 AS aspect FROM
  (SELECT i, j, CASE WHEN a < 0 THEN a + 360 ELSE a END - 90 AS d FROM (SELECT i, j, degrees(atan2((hu - hd) / 20, -(hr - hl) / 20)) AS a FROM n) t) s""", _N4))
def aspect_window(spark, sf_dir):
    return rounded(stencil.aspect_mask(grid(spark, sf_dir), M, 90.0, 60.0).select("i", "j", "aspect"), digits=7)


@query("curvature_fields", with_grid("SELECT i, j, round(c, 9) + 0.0 AS curvature, round(greatest(c - 0.5, 0) * 2, 9) + 0.0 AS convexity, round(greatest(0.5 - c, 0) * 2, 9) + 0.0 AS concavity FROM (SELECT i, j, " + clamp_sql("0.5 + (hl + hr + hd + hu - 4 * h) / 100 * 5") + " AS c FROM n) t", _N4))
def curvature_fields(spark, sf_dir):
    return rounded(stencil.curvature(grid(spark, sf_dir), M).select("i", "j", "curvature", "convexity", "concavity"))


@query("edge_magnitude", with_grid("SELECT i, j, round(sqrt((hr - hl) ** 2 + (hu - hd) ** 2), 9) + 0.0 AS edge FROM n", _N4))
def edge_magnitude(spark, sf_dir):
    return rounded(stencil.edge_magnitude(grid(spark, sf_dir), "h", "edge").select("i", "j", "edge"))


def _square(agg: str, r: int = 2, clamped: bool = True, where: str = "") -> str:
    at = lambda k, d: f"least(31, greatest(0, g.{k} + {d}.range))" if clamped else f"g.{k} + {d}.range"
    return f"SELECT g.i, g.j, {agg} FROM g, range({-r}, {r + 1}) a, range({-r}, {r + 1}) b, g o WHERE o.i = {at('i', 'a')} AND o.j = {at('j', 'b')} {where} GROUP BY g.i, g.j, g.h"


@query("box_blur_clamped", with_grid(_square("round(avg(o.h), 8) + 0.0 AS h")))
def box_blur_clamped(spark, sf_dir):
    return rounded(stencil.box_mean(grid(spark, sf_dir), M, 2), digits=8)


@query("blur_shrinking", with_grid(_square("round(avg(o.h), 8) + 0.0 AS h", clamped=False)))
def blur_shrinking(spark, sf_dir):
    return rounded(stencil.shrinking_mean(grid(spark, sf_dir), 2), digits=8)


@query("dilate_erode", with_grid(_square("max(o.h) AS dilated, min(o.h) AS eroded, g.h + least(max(o.h) - g.h, 3.0::DOUBLE) AS inflated, g.h - least(g.h - min(o.h), 3.0::DOUBLE) AS deflated")))
def dilate_erode(spark, sf_dir):
    g = grid(spark, sf_dir)
    d = stencil.extreme(stencil.extreme(g, 2, "max", out="dilated"), 2, "min", out="eroded")
    h = F.col("h")
    return d.select("i", "j", "dilated", "eroded", (h + F.least(F.col("dilated") - h, F.lit(3.0))).alias("inflated"), (h - F.least(h - F.col("eroded"), F.lit(3.0))).alias("deflated"))


@query("roughness", with_grid(_square("round(stddev_pop(o.h), 6) + 0.0 AS rough")))
def roughness(spark, sf_dir):
    return rounded(stencil.roughness(grid(spark, sf_dir), M, 2).select("i", "j", "rough"), digits=6)


@query("ambient_occlusion", with_grid(_square(f"round(1 - {clamp_sql('avg(greatest((o.h - g.h) / greatest(sqrt(a.range * a.range + b.range * b.range), 1), 0)) * 0.8')}, 8) + 0.0 AS ao", clamped=False, where="AND (a.range <> 0 OR b.range <> 0)")))
def ambient_occlusion(spark, sf_dir):
    return rounded(stencil.occlusion(grid(spark, sf_dir), M, 2, 0.8).select("i", "j", "ao"), digits=8)


_BW = "exp(-(a.range * a.range + b.range * b.range) / 4.5::DOUBLE) * exp(-((o.h - g.h) ** 2) / 50.0::DOUBLE)"


@query("bilateral", with_grid(_square(f"round(sum(o.h * {_BW}) / sum({_BW}), 8) + 0.0 AS h")))
def bilateral(spark, sf_dir):
    return rounded(stencil.bilateral(grid(spark, sf_dir), M, 2, 1.5, 5.0), digits=8)


@query("spike_removal", with_grid(_square("CASE WHEN abs(g.h - list_sort(list(o.h))[13]) > 4 THEN list_sort(list(o.h))[13] ELSE g.h END AS h")))
def spike_removal(spark, sf_dir):
    return stencil.despike(grid(spark, sf_dir), M, 2, 4.0)


@query("directional_blur", with_grid("""SELECT g.i, g.j, round(sum(o.h * w) / sum(w), 8) + 0.0 AS h FROM g, (SELECT range AS s, exp(-range * range / 4.5::DOUBLE) AS w, floor(range * cos(0.5) + 0.5) AS di, floor(range * sin(0.5) + 0.5) AS dj FROM range(-3, 4)) t, g o
  WHERE o.i = least(31, greatest(0, g.i + di)) AND o.j = least(31, greatest(0, g.j + dj)) GROUP BY 1, 2"""))
def directional_blur(spark, sf_dir):
    return rounded(stencil.directional_mean(grid(spark, sf_dir), M, 3, math.cos(0.5), math.sin(0.5)), digits=8)


# ------------------------------------------------------------------ pointwise filters and global remaps

@query("pointwise_filters", with_grid(f"""SELECT i, j,
  round(CASE WHEN h < 25 THEN 20 + {clamp_sql('(h - 20) / 5.0')} * 5 WHEN h > 45 THEN 45 + {clamp_sql('(h - 45) / 5.0')} * 5 * 0.25 ELSE h * 0.25 + 35 * 0.75 END, 9) + 0.0 AS plateau,
  round(CASE WHEN h < 32 THEN 32 - 6 * (1 - exp(-(32 - h) / 8)) WHEN h < 40 THEN 32 + t * t * (3 - 2 * t) * 8 ELSE h END, 9) + 0.0 AS coastal,
  round(floor(h / 7 + 0.5) * 7, 9) + 0.0 AS blocks, round(h + 4, 9) + 0.0 AS added, round(h * 0.7 + (2 * h - (h + 4)) * 0.3, 9) + 0.0 AS inverted
  FROM (SELECT *, {clamp_sql('(h - 32) / 8')} AS t FROM g) q"""))
def pointwise_filters(spark, sf_dir):
    h = F.col("h")
    return rounded(
        grid(spark, sf_dir).select(
            "i", "j", pointwise.plateau(h, 25.0, 45.0, 5.0).alias("plateau"), pointwise.coastal(h, 32.0, 8.0, 6.0).alias("coastal"), pointwise.blocks(h, 7.0).alias("blocks"), (h + 4.0).alias("added"), pointwise.with_strength(h, h + 4.0, 0.3, True).alias("inverted")
        )
    )


_R = "r AS (SELECT min(h) AS lo, greatest(max(h) - min(h), 1e-5) AS size FROM g), gr AS (SELECT g.*, lo, size, " + clamp_sql("(h - lo) / size") + " AS n FROM g, r)"


@query("range_remaps", with_grid(f"""SELECT i, j,
  round(h * 0.6 + (lo + (0.5 + 0.5 * CASE WHEN n < 0.5 THEN -1 ELSE 1 END * abs((n - 0.5) * 2) ** 2.0) * size) * 0.4, 8) + 0.0 AS squeezed,
  round(lo + n ** 1.5 * size, 8) + 0.0 AS gamma, round(lo + (n * 0.4 + t * t * (3 - 2 * t) * 0.6) * size, 8) + 0.0 AS s_curve,
  round((lo + 0.4 * size) * (1 - u) + h * u, 8) + 0.0 AS cut
  FROM (SELECT *, n ** (1 / 1.45::DOUBLE) AS t, {clamp_sql('(h - (lo + 0.4 * size - 0.5 * size * 0.15)) / (size * 0.15)')} AS u FROM gr) q""", _R))
def range_remaps(spark, sf_dir):
    g = grid(spark, sf_dir)
    d = reduce.squeeze(g, 0.4).withColumnRenamed("h", "squeezed")
    for name, f in (("gamma", reduce.curve(g, 0.25)), ("s_curve", reduce.curve(g, 0.8)), ("cut", reduce.cutoff(g, 0.4, 0.5))):
        d = d.join(f.withColumnRenamed("h", name), ["i", "j"])
    return rounded(d, digits=8)


_EDGE = clamp_sql("least(i * 10, (31 - i) * 10, j * 10, (31 - j) * 10) / 64.0::DOUBLE")


@query("edge_falloffs", with_grid(f"""SELECT i, j, round(lo * (1 - s) + h * s, 10) + 0.0 AS zeroed, round(h * s + rim * (1 - s), 10) + 0.0 AS blended FROM
  (SELECT gr.*, rim, e * e * (3 - 2 * e) AS s FROM (SELECT *, {_EDGE} AS e FROM gr) gr, (SELECT avg(h) AS rim FROM g WHERE i < 2 OR j < 2 OR i + 2 >= 32 OR j + 2 >= 32) b) q""", _R))
def edge_falloffs(spark, sf_dir):
    g = grid(spark, sf_dir)
    return rounded(reduce.zero_edge(g, M, 0.2).withColumnRenamed("h", "zeroed").join(reduce.border_blend(g, M, 0.2, 2).withColumnRenamed("h", "blended"), ["i", "j"]), digits=10)


# ------------------------------------------------------------------ masks

_AB = "ab AS (SELECT g.i, g.j, " + clamp_sql("g.h / 80") + " AS a, k.w AS b FROM g JOIN k USING (i, j))"


def _ab(spark, sf_dir):
    g = grid(spark, sf_dir)
    return g.select("i", "j", fm.clamp(F.col("h") / 80).alias("a")).join(mask(g).withColumnRenamed("w", "b"), ["i", "j"])


_S = lambda x, lo, hi: f"({clamp_sql(f'({x} - {lo}) / ({hi} - {lo})')})"
_OP_SQL = {
    "add": clamp_sql("a + b * 0.7"),
    "subtract": clamp_sql("a - b * 0.7"),
    "multiply": clamp_sql("a * (b * 0.7 + 0.3)"),
    "min": "least(a, b)",
    "max": "greatest(a, b)",
    "invert": "1 - a",
    "clamp": clamp_sql("a", 0.2, 0.6),
    "levels": f"{_S('a', 0.1, 0.8)} ** (1 / 1.5::DOUBLE)",
    "smoothstep": f"{_S('a', 0.2, 0.7)} * {_S('a', 0.2, 0.7)} * (3 - 2 * {_S('a', 0.2, 0.7)})",
    "remap": "0.3 + a * 0.6",
}
_OP_ARGS = {"add": {"amount": 0.7}, "subtract": {"amount": 0.7}, "multiply": {"amount": 0.7}, "clamp": {"lo": 0.2, "hi": 0.6}, "levels": {"black": 0.1, "white": 0.8, "gamma": 1.5}, "smoothstep": {"lo": 0.2, "hi": 0.7}, "remap": {"lo": 0.3, "hi": 0.9}}


@query("mask_ops", with_grid("SELECT i, j, " + ", ".join(f'round({e}, 9) + 0.0 AS "{n}"' for n, e in _OP_SQL.items()) + " FROM ab", LAYER + ", " + _AB))
def mask_ops(spark, sf_dir):
    return rounded(_ab(spark, sf_dir).select("i", "j", *(f(F.col("a"), F.col("b"), **_OP_ARGS.get(n, {})).alias(n) for n, f in masks.OPS.items())))


_COMBINE_SQL = {
    "multiply": "a * b", "add": "least(a + b, 1)", "subtract": "greatest(a - b, 0)", "min": "least(a, b)", "max": "greatest(a, b)", "replace": "b", "invert": "1 - a", "paint_override": "CASE WHEN b > 1e-4 THEN b ELSE a END",
    "paint_only": "a", "rules_only": "b", "paint_mul_rules": "a * b", "paint_add_rules": "least(a + b, 1)", "paint_overrides_rules": "CASE WHEN a > 1e-4 THEN a ELSE b END", "group_all": "a * b * 0.5", "group_any": "greatest(a, b, 0.5)",
}


@query("mask_combines", with_grid("SELECT i, j, " + ", ".join(f'round({e}, 9) + 0.0 AS "{n}"' for n, e in _COMBINE_SQL.items()) + " FROM ab", LAYER + ", " + _AB))
def mask_combines(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    made = {n: f(a, b) for n, f in (masks.COMBINES | masks.PLACEMENTS).items()}
    made |= {"group_all": masks.fold([a, b, F.lit(0.5)], True), "group_any": masks.fold([a, b, F.lit(0.5)], False)}
    return rounded(_ab(spark, sf_dir).select("i", "j", *(c.alias(n) for n, c in made.items())))


_EFFECT_ARGS = {"invert": {}, "levels": {"black": 0.1, "white": 0.8, "gamma": 1.5}, "remap": {"lo": 0.2, "hi": 0.7}, "contrast": {"amount": 1.8}, "clamp": {"lo": 0.2, "hi": 0.6}, "curve": {"contrast": 2.0}, "smoothstep": {"lo": 0.2, "hi": 0.7}}
_EFFECT_SQL = {
    "invert": "1 - a",
    "levels": _OP_SQL["levels"],
    "remap": _S("a", 0.2, 0.7),
    "contrast": clamp_sql("(a - 0.5) * 1.8 + 0.5"),
    "clamp": clamp_sql("a", 0.2, 0.6),
    "curve": "a + (a * a * (3 - 2 * a) - a) * (2 / 3.0::DOUBLE)",
    "smoothstep": _OP_SQL["smoothstep"],
}


@query("mask_effects", with_grid("SELECT i, j, " + ", ".join(f'round({clamp_sql(f"a * 0.25 + ({e}) * 0.75")}, 13) + 0.0 AS "{n}"' for n, e in _EFFECT_SQL.items()) + " FROM ab", LAYER + ", " + _AB))
def mask_effects(spark, sf_dir):
    return rounded(_ab(spark, sf_dir).select("i", "j", *(masks.effect(n, F.col("a"), 0.75, **p).alias(n) for n, p in _EFFECT_ARGS.items())), digits=13)


@query("mask_nodes", with_grid(f"""SELECT i, j, {K9.format(_S('h', 20, 60))} AS height, {K9.format(clamp_sql('1 - abs(h - 32) / 9'))} AS sea,
  {K9.format(f"CASE WHEN h >= 40 THEN 1 ELSE {clamp_sql('1 - (40 - h) / 10.0')} END")} AS above, {K9.format(f"CASE WHEN h <= 30 THEN 1 ELSE {clamp_sql('1 - (h - 30) / 10.0')} END")} AS below,
  {K9.format(f"least(CASE WHEN h >= 30 THEN 1 ELSE {clamp_sql('1 - (30 - h) / 5.0')} END, CASE WHEN h <= 40 THEN 1 ELSE {clamp_sql('1 - (h - 40) / 5.0')} END)")} AS amid FROM g"""))
def mask_nodes(spark, sf_dir):
    h = F.col("h")
    return rounded(grid(spark, sf_dir).select("i", "j", fm.span(h, 20.0, 60.0).alias("height"), masks.sea_level(h, 32.0, 9.0).alias("sea"), masks.above(h, 40.0, 10.0).alias("above"), masks.below(h, 30.0, 10.0).alias("below"), masks.between(h, 30.0, 40.0, 5.0).alias("amid")))


_POLY = [(40.0, 30.0), (250.0, 60.0), (200.0, 260.0), (90.0, 200.0)]


def _pip_sql() -> str:
    hits, (xj, yj) = [], _POLY[-1]
    for xi, yi in _POLY:
        hits.append(f"CASE WHEN ({yi} > z) <> ({yj} > z) AND x < {xj - xi} * (z - {yi}) / {max(yj - yi, 1e-12)!r} + {xi} THEN 1 ELSE 0 END")
        xj, yj = xi, yi
    return f"({' + '.join(hits)}) % 2"


def _seg_sql(a, b) -> str:
    (ax, ay), (bx, by) = a, b
    t = clamp_sql(f"((x - {ax}) * {bx - ax} + (z - {ay}) * {by - ay}) / {(bx - ax) ** 2 + (by - ay) ** 2}::DOUBLE")
    return f"sqrt((x - ({ax} + {t} * {bx - ax})) ** 2 + (z - ({ay} + {t} * {by - ay})) ** 2)"


@query("polygon_and_spline_masks", f"WITH {_CELLS} SELECT i, j, CAST({_pip_sql()} AS INT) AS inside, round(least({', '.join(_seg_sql(a, b) for a, b in zip(_POLY, _POLY[1:], strict=False))}), 8) + 0.0 AS spline, round(least({', '.join(_seg_sql(a, b) for a, b in zip(_POLY, [*_POLY[1:], _POLY[0]], strict=True))}), 8) + 0.0 AS outline FROM s")
def polygon_and_spline_masks(spark, sf_dir):
    x, z = F.col("x"), F.col("z")
    c = source.with_world(source.cells(spark, M), M)
    return rounded(c.select("i", "j", fm.in_polygon(x, z, _POLY, floored=True).cast("int").alias("inside"), fm.polyline_distance(x, z, _POLY).alias("spline"), fm.polyline_distance(x, z, _POLY, True).alias("outline")), digits=8)


@query("mask_coverage", with_grid("SELECT avg(CASE WHEN w > 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS coverage FROM k", LAYER))
def mask_coverage(spark, sf_dir):
    return reduce.coverage(mask(grid(spark, sf_dir)), "w")


# ------------------------------------------------------------------ statistics

@query("height_histogram", with_grid("""SELECT CAST(b.range AS INT) AS bin, count(t.h) AS n, count(t.h) / 1024.0::DOUBLE AS fraction FROM range(16) b
  LEFT JOIN (SELECT h, least(15, floor((h - lo) / (hi - lo) * 16)) AS bin FROM g, (SELECT min(h) AS lo, max(h) AS hi FROM g) r) t ON t.bin = b.range GROUP BY 1"""))
def height_histogram(spark, sf_dir):
    return reduce.histogram(grid(spark, sf_dir), 16)


@query("hypsometric_curve", with_grid("SELECT CAST(range AS INT) AS k, round(range / 31.0::DOUBLE, 9) + 0.0 AS fraction, v.h AS elevation FROM range(32) JOIN (SELECT h, row_number() OVER (ORDER BY h) - 1 AS rn FROM g) v ON v.rn = floor(range / 31.0::DOUBLE * 1023 + 0.5)"))
def hypsometric_curve(spark, sf_dir):
    return rounded(reduce.hypsometry(grid(spark, sf_dir), 32), "fraction")


@query("hypsometric_integral", with_grid("""SELECT round(sum(0.5 * (p + q) / 31), 8) + 0.0 AS integral, any_value(lo) AS z_min, any_value(hi) AS z_max, round(any_value(mean), 8) + 0.0 AS z_mean, round(any_value(hi - lo), 9) + 0.0 AS relief FROM
  (SELECT lo, hi, mean, (h - lo) / (hi - lo) AS q, lag((h - lo) / (hi - lo)) OVER (ORDER BY range) AS p FROM range(32) JOIN (SELECT h, row_number() OVER (ORDER BY h) - 1 AS rn FROM g) v ON v.rn = floor(range / 31.0::DOUBLE * 1023 + 0.5), (SELECT min(h) AS lo, max(h) AS hi, avg(h) AS mean FROM g) m) t"""))
def hypsometric_integral(spark, sf_dir):
    return rounded(rounded(reduce.hypsometric_integral(grid(spark, sf_dir), 32), "integral", "z_mean", digits=8), "relief")


@query("strided_mean", with_grid("SELECT round(avg(h), 8) + 0.0 AS mean FROM g WHERE i % 4 = 0 AND j % 4 = 0"))
def strided_mean(spark, sf_dir):
    return rounded(reduce.strided_mean(grid(spark, sf_dir), 4), digits=8)


@query("field_parity", with_grid("SELECT max(abs(g.h - y.h)) AS max_abs, round(sqrt(avg((g.h - y.h) ** 2)), 8) + 0.0 AS rmse, round(sqrt(avg((g.h - y.h) ** 2)) / greatest(max(y.h) - min(y.h), 1e-6), 8) + 0.0 AS normalised_rmse FROM g JOIN y USING (i, j)", LAYER))
def field_parity(spark, sf_dir):
    return rounded(reduce.field_difference(grid(spark, sf_dir), layer(spark, sf_dir)), "rmse", "normalised_rmse", digits=8)


# ------------------------------------------------------------------ rules and lookups

@query("stratum_lookup", with_grid("SELECT i, j, CASE WHEN d < 4 THEN 0.2 WHEN d < 10 THEN 0.5 WHEN d < 25 THEN 0.8 ELSE 0.8 END::DOUBLE AS hardness FROM (SELECT i, j, greatest(0, 40 - h) AS d FROM g) t"))
def stratum_lookup(spark, sf_dir):
    d = grid(spark, sf_dir).withColumn("d", F.greatest(F.lit(0.0), 40.0 - F.col("h")))
    return d.select("i", "j", combine.lookup_band(d, "d", [4.0, 6.0, 15.0], [0.2, 0.5, 0.8], 0.5).alias("hardness"))


_BANDS = [(0, 1, -1000.0, 30.0, 0.0, 1.0), (1, 2, 25.0, 45.0, 0.0, 0.6), (2, 3, 40.0, 1000.0, 0.0, 1.0), (3, 4, 28.0, 36.0, 0.7, 1.0)]


@query("classify_bands", with_grid("SELECT g.i, g.j, coalesce(max_by(id, ord), 0) AS biome FROM g JOIN k USING (i, j) LEFT JOIN (VALUES " + ", ".join(map(str, _BANDS)) + ") b(ord, id, lo, hi, wlo, whi) ON g.h BETWEEN lo AND hi AND w BETWEEN wlo AND whi GROUP BY g.i, g.j", LAYER))
def classify_bands(spark, sf_dir):
    g = grid(spark, sf_dir)
    bands = spark.createDataFrame(_BANDS, "ord int, id int, lo double, hi double, wlo double, whi double")
    d = g.join(mask(g), ["i", "j"])
    return combine.classify(d, bands, [("h", "lo", "hi"), ("w", "wlo", "whi")], "biome").select("i", "j", "biome")


@query("first_material_ids", with_grid("SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS slot, id FROM (SELECT CAST(floor(h) % 7 AS INT) AS id, min(j * 32 + i) AS pos FROM g WHERE floor(h) % 7 <> 0 GROUP BY 1) t QUALIFY slot < 4"))
def first_material_ids(spark, sf_dir):
    return combine.first_ids(grid(spark, sf_dir).withColumn("m", (F.floor("h") % 7).cast("int")), M, "m")


@query("changed_tiles", with_grid("SELECT DISTINCT CAST(g.i // 8 AS INT) AS tx, CAST(g.j // 8 AS INT) AS tz FROM g WHERE h > (SELECT quantile_disc(h, 0.999) FROM g)"))
def changed_tiles(spark, sf_dir):
    g = grid(spark, sf_dir)
    top = g.select("h").orderBy(F.desc("h")).limit(10).collect()
    limit = sorted(r.h for r in top)[-2]
    return combine.changed_tiles(combine.tile_digests(g, M), combine.tile_digests(g.withColumn("h", F.when(F.col("h") > limit, -1.0).otherwise(F.col("h"))), M))


@query("dirty_tiles_spread", "SELECT DISTINCT CAST(tx + a.range AS INT) AS tx, CAST(tz + b.range AS INT) AS tz FROM (VALUES (0, 0), (3, 2)) t(tx, tz), range(-1, 2) a, range(-1, 2) b WHERE tx + a.range BETWEEN 0 AND 3 AND tz + b.range BETWEEN 0 AND 3")
def dirty_tiles_spread(spark, sf_dir):
    return combine.spread_tiles(spark.createDataFrame([(0, 0), (3, 2)], "tx int, tz int"), M, 1)


@query("dirty_tile_bounds", "SELECT CAST(greatest(8 * 1 - 2, 0) AS INT) AS i0, 0 AS j0, 32 AS i1, CAST(8 * 3 + 2 AS INT) AS j1")
def dirty_tile_bounds(spark, sf_dir):
    return combine.tile_bounds(spark.createDataFrame([(1, 0), (3, 2)], "tx int, tz int"), M, 2).select(*(F.col(c).cast("int").alias(c) for c in ("i0", "j0", "i1", "j1")))


@query("tile_scoped_ramp", f"SELECT i, j, round(h, 9) + 0.0 AS h FROM (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j, 100 * {clamp_sql('(a.range + 0.5) / 32')} AS h FROM range(32) a, range(32) b) t WHERE (i // 8 = 1 AND j // 8 = 0) OR (i // 8 = 3 AND j // 8 = 2)")
def tile_scoped_ramp(spark, sf_dir):
    c = source.only_tiles(source.cells(spark, M), spark.createDataFrame([(1, 0), (3, 2)], "tx int, tz int"), M)
    return rounded(source.ramp(c, M))


@query("finest_ancestor", """WITH r AS (SELECT CAST(3 AS INT) AS level, CAST(a.range * 3 AS INT) AS i, CAST(b.range * 5 AS INT) AS j FROM range(10) a, range(6) b), p(level, tx, tz) AS (VALUES (0, 0, 0), (1, 0, 0), (1, 1, 1), (2, 1, 0), (3, 3, 3), (3, 0, 0))
  SELECT r.level, i, j, max(p.level) AS found FROM r JOIN p ON p.level <= r.level AND p.tx = (i >> (r.level - p.level)) // 8 AND p.tz = (j >> (r.level - p.level)) // 8 GROUP BY 1, 2, 3""")
def finest_ancestor(spark, sf_dir):
    req = spark.range(60).select(F.lit(3).alias("level"), (F.expr("id div 6") * 3).cast("int").alias("i"), (F.col("id") % 6 * 5).cast("int").alias("j"))
    pages = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 1, 1), (2, 1, 0), (3, 3, 3), (3, 0, 0)], "level int, tx int, tz int")
    return combine.finest_ancestor(req, pages, 8)


# ------------------------------------------------------------------ hydrology

_DIRS = "(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)"
_FLOW = f"""e AS (SELECT g.i, g.j, d.k, (g.h - o.h) / CASE WHEN d.di <> 0 AND d.dj <> 0 THEN sqrt(2.0) ELSE 1 END AS s, d.di, d.dj FROM g, (VALUES {_DIRS}) d(k, di, dj), g o WHERE o.i = g.i + d.di AND o.j = g.j + d.dj),
f AS (SELECT i, j, CASE WHEN max(s) > 1e-12 THEN min(k) FILTER (WHERE s >= m - 1e-12) END AS k FROM (SELECT *, max(s) OVER (PARTITION BY i, j) AS m FROM e) t GROUP BY i, j),
fl AS (SELECT f.i, f.j, f.k, f.i + d.di AS ri, f.j + d.dj AS rj FROM f LEFT JOIN (VALUES {_DIRS}) d(k, di, dj) ON d.k = f.k)"""
_PATHS = "WITH RECURSIVE " + with_grid("", _FLOW).strip().removeprefix("WITH ") + ", w AS (SELECT i AS si, j AS sj, i, j FROM fl UNION ALL SELECT w.si, w.sj, fl.ri, fl.rj FROM w JOIN fl ON fl.i = w.i AND fl.j = w.j WHERE fl.ri IS NOT NULL)"


@query("flow_direction_d8", with_grid("SELECT i, j, CAST(coalesce(k, 255) AS INT) AS dir FROM f", _FLOW))
def flow_direction_d8(spark, sf_dir):
    return hydrology.flow_direction(grid(spark, sf_dir)).select("i", "j", F.col("dir").cast("int").alias("dir"))


@query("flow_receivers", with_grid("SELECT i, j, CAST(ri AS INT) AS ri, CAST(rj AS INT) AS rj FROM fl", _FLOW))
def flow_receivers(spark, sf_dir):
    return hydrology.receivers(grid(spark, sf_dir)).select("i", "j", F.col("ri").cast("int").alias("ri"), F.col("rj").cast("int").alias("rj"))


@query("flow_outlets", with_grid("SELECT i, j FROM fl WHERE k IS NULL", _FLOW))
def flow_outlets(spark, sf_dir):
    return hydrology.outlets(grid(spark, sf_dir))


@query("flow_accumulation", _PATHS + " SELECT i, j, CAST(count(*) AS DOUBLE) AS area FROM w GROUP BY i, j")
def flow_accumulation(spark, sf_dir):
    return hydrology.accumulate(grid(spark, sf_dir)).select("i", "j", "area")


_ENDS = "SELECT w.si AS i, w.sj AS j, w.i AS oi, w.j AS oj FROM w JOIN fl ON fl.i = w.i AND fl.j = w.j WHERE fl.ri IS NULL"


@query("watershed_labels", f"{_PATHS} SELECT i, j, CAST(oi AS INT) AS oi, CAST(oj AS INT) AS oj FROM ({_ENDS}) t")
def watershed_labels(spark, sf_dir):
    return hydrology.watersheds(grid(spark, sf_dir)).select("i", "j", F.col("oi").cast("int").alias("oi"), F.col("oj").cast("int").alias("oj"))


@query("watershed_sizes", f"{_PATHS} SELECT CAST(oi AS INT) AS oi, CAST(oj AS INT) AS oj, count(*) AS cells FROM ({_ENDS}) t GROUP BY 1, 2")
def watershed_sizes(spark, sf_dir):
    return hydrology.watershed_sizes(grid(spark, sf_dir)).select(F.col("oi").cast("int").alias("oi"), F.col("oj").cast("int").alias("oj"), "cells")


@query("watershed_boundaries", f"""{_PATHS}, l AS ({_ENDS}) SELECT l.i, l.j, CAST(max(CASE WHEN n.i IS NULL OR n.oi <> l.oi OR n.oj <> l.oj THEN 1 ELSE 0 END) AS DOUBLE) AS edge FROM l, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(di, dj)
  LEFT JOIN l n ON n.i = l.i + d.di AND n.j = l.j + d.dj GROUP BY l.i, l.j""")
def watershed_boundaries(spark, sf_dir):
    d = hydrology.watersheds(grid(spark, sf_dir)).withColumn("label", F.concat_ws(",", "oi", "oj"))
    return hydrology.boundaries(d, "label").select("i", "j", "edge")


@query("fill_depressions", "WITH RECURSIVE " + with_grid("", """lv AS (SELECT DISTINCT h AS v FROM g),
  up AS (SELECT i, j, h AS v FROM g WHERE i = 0 OR j = 0 OR i = 31 OR j = 31 UNION SELECT g.i, g.j, greatest(g.h, up.v) FROM up JOIN g ON abs(g.i - up.i) <= 1 AND abs(g.j - up.j) <= 1 AND (g.i <> up.i OR g.j <> up.j) AND g.i BETWEEN 1 AND 30 AND g.j BETWEEN 1 AND 30)""").strip().removeprefix("WITH ") + " SELECT i, j, min(v) AS h FROM up GROUP BY i, j")
def fill_depressions(spark, sf_dir):
    return hydrology.fill_depressions(grid(spark, sf_dir), M).select("i", "j", "h")


@query("ridge_cells", with_grid("SELECT g.i, g.j, CASE WHEN g.h > max(o.h) THEN 1.0 ELSE 0.0 END::DOUBLE AS ridge FROM g JOIN g o ON abs(o.i - g.i) <= 1 AND abs(o.j - g.j) <= 1 AND (o.i <> g.i OR o.j <> g.j) GROUP BY g.i, g.j, g.h"))
def ridge_cells(spark, sf_dir):
    return hydrology.ridges(grid(spark, sf_dir)).select("i", "j", "ridge")


@query("multi_flow_pass", with_grid(f"""SELECT g.i, g.j, round(1 + coalesce(sum(e.s / t.total), 0), 8) + 0.0 AS flow FROM g LEFT JOIN (SELECT *, i + di AS ti, j + dj AS tj FROM e WHERE s > 0) e ON e.ti = g.i AND e.tj = g.j
  LEFT JOIN (SELECT i, j, sum(s) AS total FROM e WHERE s > 0 GROUP BY 1, 2) t ON t.i = e.i AND t.j = e.j GROUP BY 1, 2""", _FLOW))
def multi_flow_pass(spark, sf_dir):
    return rounded(hydrology.multi_flow(grid(spark, sf_dir), M, 1).select("i", "j", "flow"), digits=8)


_THERMAL = lambda src: f"""(SELECT i, j, h - coalesce(o.out, 0) + coalesce(n.inn, 0) AS h FROM {src} LEFT JOIN (SELECT i, j, sum(x) AS out FROM ({_EXCESS(src)}) a GROUP BY 1, 2) o USING (i, j) LEFT JOIN (SELECT ti AS i, tj AS j, sum(x) AS inn FROM ({_EXCESS(src)}) b GROUP BY 1, 2) n USING (i, j))"""
_EXCESS = lambda src: f"""SELECT s.i, s.j, o.i AS ti, o.j AS tj, (s.h - o.h - tan(radians(20.0)) * sqrt(power(d.di * 10, 2) + power(d.dj * 10, 2))) * 0.125 * 0.6 AS x FROM {src} s, (VALUES {_DIRS}) d(k, di, dj), {src} o WHERE o.i = s.i + d.di AND o.j = s.j + d.dj AND s.h - o.h - tan(radians(20.0)) * sqrt(power(d.di * 10, 2) + power(d.dj * 10, 2)) > 0"""


@query("thermal_erosion", with_grid("SELECT i, j, round(h, 7) + 0.0 AS h FROM t2", f"t1 AS {_THERMAL('g')}, t2 AS {_THERMAL('t1')}"))
def thermal_erosion(spark, sf_dir):
    return rounded(hydrology.thermal(grid(spark, sf_dir), M, 20.0, 0.6, 2), digits=7)


@query("seed_distance")
def seed_distance(spark, sf_dir):
    g = grid(spark, sf_dir).withColumn("seed", (F.col("h") > 60).cast("double"))
    return rounded(hydrology.seed_distance(g, M, "seed").select("i", "j", "distance"))


@query("strahler_order")
def strahler_order(spark, sf_dir):
    g = hydrology.persisted(hydrology.accumulate(grid(spark, sf_dir)))
    return hydrology.strahler(g, "area", 3.0).select("i", "j", F.col("order").cast("int").alias("strahler"))


@query("channel_fields", _PATHS + ", a AS (SELECT i, j, CAST(count(*) AS DOUBLE) AS area FROM w GROUP BY i, j) SELECT i, j, CASE WHEN area >= 3 THEN CAST(1 + floor(log2(area / 3)) AS INT) ELSE 0 END AS log_order, round(CASE WHEN area >= 3 THEN 1.5 * sqrt(area / 3) ELSE 0 END, 9) + 0.0 AS width, round(least(0.02 * area ** 0.5 * 0.3 * 10, 5.0, 2.0), 9) + 0.0 AS step FROM a")
def channel_fields(spark, sf_dir):
    a = F.col("area")
    d = hydrology.accumulate(grid(spark, sf_dir))
    _, step = fm.stream_power_step(a, F.lit(0.3), 0.02, 0.5, 1.0, 1.0, 10.0, 5.0, 2.0)
    return rounded(d.select("i", "j", hydrology.stream_order_log2(a, 3.0).alias("log_order"), hydrology.channel_width(a, 3.0, 1.5).alias("width"), step.alias("step")))


_SMEAR = lambda src: f"(SELECT s.i, s.j, s.a * 0.4 + max(o.a) * 0.6 AS a FROM {src} s JOIN {src} o ON abs(o.i - s.i) + abs(o.j - s.j) <= 1 GROUP BY s.i, s.j, s.a)"


@query("mask_simple_flow", with_grid("SELECT i, j, round(a, 8) + 0.0 AS a FROM s2", LAYER + ", " + _AB + f", s1 AS {_SMEAR('ab')}, s2 AS {_SMEAR('s1')}"))
def mask_simple_flow(spark, sf_dir):
    return rounded(hydrology.smear(_ab(spark, sf_dir).select("i", "j", "a"), "a", 2, 0.6), digits=8)


# ------------------------------------------------------------------ streams

@query("debounced_edits", """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS b FROM o) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS edits FROM s GROUP BY user_id, b""")
def debounced_edits(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id is not null")
    return edits.debounced(e, "30 minutes")


@query("latest_edits", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_edits(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "event_id")
    return edits.latest(e, "user_id", "ts", "event_id").select("user_id", "event_type", "ts")


@query("budgeted_requests", "SELECT event_id, spent FROM (SELECT event_id, sum(1 + event_id % 7) OVER (ORDER BY event_id % 13 DESC, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM events) t WHERE spent <= 300")
def budgeted_requests(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (1 + F.col("event_id") % 7).alias("cost"), (F.col("event_id") % 13).alias("priority"))
    return edits.budgeted(e, 300, "cost", F.desc("priority"), F.col("event_id")).select("event_id", "spent")


# ------------------------------------------------------------------ filters, regions, documents, rasters

_O3 = filters.Options(amount=6.0, frequency=0.02, octaves=3, seed=9)


def _filter_query(kind: str, o: filters.Options, digits: int = 9):
    def run(spark, sf_dir):
        return rounded(filters.apply(grid(spark, sf_dir), M, kind, o), digits=digits)

    return run


def _noise_filter_sql(expr: str, formula: str, stride: int) -> str:
    ctes, last = _octaves_sql(expr, 9, 0.02, 3, stride, 2.0)
    return f"WITH {GRID}, s AS (SELECT i, j, {_XZ} FROM c), {ctes} SELECT g.i, g.j, round(g.h + ({formula}) * 6, 9) + 0.0 AS h FROM {last} JOIN g USING (i, j)"


_FBM01 = f"{clamp_sql('((o0 + o1 * 0.5 + o2 * 0.25) / 1.75 + 1) / 2')} * 2 - 1"
query("filter_noise_perlin", _noise_filter_sql(_PERLIN, _FBM01, 1013))(_filter_query("noise_perlin", _O3))
query("filter_noise_value", _noise_filter_sql(_VALUE, _FBM01, 1013))(_filter_query("noise_value", _O3))
query("filter_noise_billow", _noise_filter_sql(_PERLIN, "(abs(o0) + abs(o1) * 0.5 + abs(o2) * 0.25) / 1.75 * 2 - 1", 1301))(_filter_query("noise_billow", _O3))
query("filter_noise_wave", f"WITH {GRID}, s AS (SELECT i, j, {_XZ} FROM c) SELECT g.i, g.j, round(g.h + sin(x * 0.02 / 0.5) * cos(z * 0.02 * 0.7 * sqrt(0.5)) * 6, 8) + 0.0 AS h FROM s JOIN g USING (i, j)")(_filter_query("noise_wave", filters.Options(amount=6.0, frequency=0.02, anisotropy=0.5), 8))
query("filter_noise_white", with_grid(f"SELECT i, j, round(h + ({_lattice_sql('i', 'j', 9)} / 4294967295.0::DOUBLE * 2 - 1) * 6, 9) + 0.0 AS h FROM g"))(_filter_query("noise_white", _O3))


def _ridged_filter_sql() -> str:
    ctes, last = _octaves_sql(_PERLIN, 9, 0.02, 3, 9173, 2.0)
    r = lambda o: clamp_sql(f"1 - abs({o})")
    return f"""WITH {GRID}, s AS (SELECT i, j, {_XZ} FROM c), {ctes}, r0 AS (SELECT *, {r('o0')} * {r('o0')} AS s0 FROM {last}),
      r1 AS (SELECT *, {r('o1')} * {r('o1')} * {clamp_sql('s0 * 2')} AS s1 FROM r0), r2 AS (SELECT *, {r('o2')} * {r('o2')} * {clamp_sql('s1 * 2')} AS s2 FROM r1)
      SELECT g.i, g.j, round(g.h + ({clamp_sql('(s0 + s1 * 0.5 + s2 * 0.25) / 1.75')} * 2 - 1) * 6, 9) + 0.0 AS h FROM r2 JOIN g USING (i, j)"""


query("filter_noise_ridged", _ridged_filter_sql())(_filter_query("noise_ridged", _O3))
query("filter_smooth_half", with_grid(f"SELECT g.i, g.j, round(g.h * 0.5 + t.h * 0.5, 8) + 0.0 AS h FROM g JOIN ({_square('avg(o.h) AS h', 1)}) t USING (i, j)"))(_filter_query("smooth", filters.Options(radius=1, strength=0.5), 8))
query("filter_smooth_inverted", with_grid(f"SELECT g.i, g.j, round(g.h + (g.h - t.h), 8) + 0.0 AS h FROM g JOIN ({_square('avg(o.h) AS h', 1)}) t USING (i, j)"))(_filter_query("smooth", filters.Options(radius=1, invert=True), 8))
query("filter_balloon", with_grid(f"SELECT n.i, n.j, round(n.h * (1 - q) + (n.h + least(top - n.h, 3)) * q, 8) + 0.0 AS h FROM (SELECT *, {clamp_sql('(degrees(atan(sqrt(((hr - h) / 10) ** 2 + ((hu - h) / 10) ** 2))) - 10) / 50')} AS q FROM n) n JOIN ({_square('max(o.h) AS top', 1)}) t USING (i, j)", _N4))(
    _filter_query("balloon", filters.Options(radius=1, amount=3.0, slope_min=10.0, slope_max=60.0), 8)
)
_SM = lambda u: f"({u} * {u} * {u} * ({u} * ({u} * 6 - 15) + 10))"
query("filter_terrace", with_grid(f"""SELECT i, j, round({{}}, 8) + 0.0 AS h FROM (SELECT *, CASE WHEN fr <= 0.75 THEN b ELSE b + {_SM('((fr - 0.75) / 0.25)')} END AS st, CASE WHEN fr <= 0.75 THEN (0.75 - fr) / 0.75 ELSE 0 END AS ed FROM
  (SELECT *, floor((h - lo) / (size / 6)) AS b, (h - lo) / (size / 6) - floor((h - lo) / (size / 6)) AS fr FROM gr) t) q""".replace("{}", "least(greatest((lo + st * size / 6) * (1 - (1 - " + _SM("ed") + ") * 0.15 * 0.65) + h * ((1 - " + _SM("ed") + ") * 0.15 * 0.65), lo), lo + size)"), _R))(_filter_query("terrace_simple", filters.Options(amount=6.0), 8))
query("filter_hexagons", with_grid("""SELECT g.i, g.j, round(g.h * 0.4 + o.h * 0.6, 9) + 0.0 AS h FROM (SELECT *, (i + 0.5) * 10 AS x, (j + 0.5) * 10 AS z, round(x * 2 / 3.0::DOUBLE / 50) AS q, round((-x / 3.0::DOUBLE + sqrt(3.0) / 3 * z) / 50) AS r,
  least(1, greatest(0, 50 * 1.5 * q / 320)) AS u, least(1, greatest(0, 50 * (sqrt(3.0) / 2 * q + sqrt(3.0) * r) / 320)) AS v FROM g) g JOIN g o ON o.i = round(u * 31) AND o.j = round(v * 31)"""))(_filter_query("hexagons", filters.Options(amount=6.0, frequency=0.02)))

_DOC = {
    "nodes": [
        {"kind": "ramp", "params": {"direction": 0.3, "height_min": 10.0, "height_max": 60.0}},
        {"kind": "effect_filter", "params": {"filter": "add_set", "amount": 5.0}, "masks": [{"source": "above", "at": 30.0, "falloff": 10.0}]},
        {"group": [{"kind": "flat", "params": {"height": 4.0}}, {"kind": "flat", "params": {"height": 2.0}, "blend": "multiply", "opacity": 0.5}], "opacity": 0.5},
        {"kind": "plateau", "params": {"low": 20.0, "high": 40.0, "soft": 5.0}, "enabled": False},
        {"kind": "plateau", "params": {"low": 25.0, "high": 45.0, "soft": 5.0}, "opacity": 0.8},
    ]
}


@query("layer_document", f"""WITH {_CELLS}, a AS (SELECT i, j, 10 + 50 * {clamp_sql('((i + 0.5) / 32) * cos(0.3) + ((j + 0.5) / 32) * sin(0.3)')} AS h FROM c),
  b AS (SELECT i, j, h + 5 * w AS h FROM (SELECT *, CASE WHEN h >= 30 THEN 1 ELSE {clamp_sql('1 - (30 - h) / 10.0')} END AS w FROM a) t), d AS (SELECT i, j, h + 0.5 * (4 * 0.5 + 4 * 2 * 0.5) AS h FROM b)
  SELECT i, j, round(h * 0.2 + 0.8 * CASE WHEN h < 25 THEN 20 + {clamp_sql('(h - 20) / 5.0')} * 5 WHEN h > 45 THEN 45 + {clamp_sql('(h - 45) / 5.0')} * 5 * 0.25 ELSE h * 0.25 + 35 * 0.75 END, 9) + 0.0 AS h FROM d""")
def layer_document(spark, sf_dir):
    return rounded(stack.evaluate(spark, M, _DOC))


@query("height_metadata", with_grid("SELECT min(h) AS min, max(h) AS max, 32 AS width, 32 AS height, 320.0::DOUBLE AS world_size_x, 320.0::DOUBLE AS world_size_z, 10.0::DOUBLE AS dx, 10.0::DOUBLE AS dz FROM g"))
def height_metadata(spark, sf_dir):
    return raster.metadata(grid(spark, sf_dir), M)


@query("height_quantised", with_grid("SELECT i, j, CAST(floor((h - lo) / size * 65535) AS INT) AS q FROM gr", _R))
def height_quantised(spark, sf_dir):
    return raster.quantised(grid(spark, sf_dir)).select("i", "j", "q")


@query("normal_map", with_grid("SELECT i, j, CAST(floor((-(hr - h) / 10 / s * 0.5 + 0.5) * 255) AS INT) AS r, CAST(floor((-(hu - h) / 10 / s * 0.5 + 0.5) * 255) AS INT) AS g, CAST(floor((1 / s * 0.5 + 0.5) * 255) AS INT) AS b FROM (SELECT *, sqrt(((hr - h) / 10) ** 2 + ((hu - h) / 10) ** 2 + 1) AS s FROM n) t", _N4))
def normal_map(spark, sf_dir):
    return raster.normals(grid(spark, sf_dir), M)


@query("collision_vertices", with_grid("SELECT CAST(j // 4 * 8 + i // 4 + 1 AS BIGINT) AS id, i * 10.0::DOUBLE AS x, h AS y, j * 10.0::DOUBLE AS z FROM g WHERE i % 4 = 0 AND j % 4 = 0"))
def collision_vertices(spark, sf_dir):
    return raster.mesh(grid(spark, sf_dir), M, 4)[0]


@query("collision_quads", "SELECT CAST(b.range * 8 + a.range + 1 AS BIGINT) AS a, CAST(b.range * 8 + a.range + 9 AS BIGINT) AS b, CAST(b.range * 8 + a.range + 10 AS BIGINT) AS c, CAST(b.range * 8 + a.range + 2 AS BIGINT) AS d FROM range(7) a, range(7) b")
def collision_quads(spark, sf_dir):
    return raster.mesh(grid(spark, sf_dir), M, 4)[1]


@query("tile_packages")
def tile_packages(spark, sf_dir):
    return raster.tile_bytes(grid(spark, sf_dir), M)


# ------------------------------------------------------------------ derivatives, disks, mask noise, standing water

_P = """d AS (SELECT n.i, n.j, (hr - hl) / 20 AS p, (hu - hd) / 20 AS q, (hr - 2 * n.h + hl) / 100 AS r, (hu - 2 * n.h + hd) / 100 AS t, (a.h - b.h - c2.h + e.h) / 400 AS s FROM n
  JOIN g a ON a.i = least(n.i + 1, 31) AND a.j = least(n.j + 1, 31) JOIN g b ON b.i = least(n.i + 1, 31) AND b.j = greatest(n.j - 1, 0)
  JOIN g c2 ON c2.i = greatest(n.i - 1, 0) AND c2.j = least(n.j + 1, 31) JOIN g e ON e.i = greatest(n.i - 1, 0) AND e.j = greatest(n.j - 1, 0)),
w AS (SELECT i, j, r + t AS laplacian, CASE WHEN p * p + q * q < 1e-12 THEN 0 ELSE -(r * p * p + 2 * s * p * q + t * q * q) / greatest((p * p + q * q) * (1 + p * p + q * q) ** 1.5, 1e-12) END AS profile,
  CASE WHEN p * p + q * q < 1e-12 THEN 0 ELSE -(t * p * p - 2 * s * p * q + r * q * q) / greatest((p * p + q * q) ** 1.5, 1e-12) END AS plan,
  ((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * (1 + p * p + q * q) ** 1.5) AS mean, (r * t - s * s) / (1 + p * p + q * q) ** 2 AS gaussian FROM d)"""


@query("slope_aspect_radius", with_grid("SELECT i, j, round(degrees(atan(sqrt(p * p + q * q))) / 90, 8) + 0.0 AS slope, round(CASE WHEN atan2(q, -p) < 0 THEN atan2(q, -p) + 2 * pi() ELSE atan2(q, -p) END / (2 * pi()), 7) + 0.0 AS aspect FROM d", _N4 + ", " + _P))
def slope_aspect_radius(spark, sf_dir):
    d = derivatives.slope(grid(spark, sf_dir), M).select("i", "j", "slope", "aspect")
    return rounded(rounded(d, "slope", digits=8), "aspect", digits=7)


@query("surface_curvatures", with_grid("SELECT i, j, " + ", ".join(f"round(0.5 + 0.5 * {k} / (SELECT greatest(max(abs({k})), 1e-6) FROM w), 8) + 0.0 AS {k}" for k in derivatives.CURVATURES) + ", round(greatest(mean, 0) / (SELECT greatest(max(abs(mean)), 1e-6) FROM w), 8) + 0.0 AS convex, round(greatest(-mean, 0) / (SELECT greatest(max(abs(mean)), 1e-6) FROM w), 8) + 0.0 AS concave FROM w", _N4 + ", " + _P))
def surface_curvatures(spark, sf_dir):
    return rounded(derivatives.curvatures(grid(spark, sf_dir), M).drop("h"), digits=8)


_DISK = "FROM ab JOIN ab o ON o.i BETWEEN ab.i - 2 AND ab.i + 2 AND o.j BETWEEN ab.j - 2 AND ab.j + 2 AND (o.i - ab.i) ** 2 + (o.j - ab.j) ** 2 <= 4 GROUP BY 1, 2"


@query("mask_morphology", with_grid(f"SELECT ab.i, ab.j, round(max(o.a), 9) + 0.0 AS dilated, round(min(o.a), 9) + 0.0 AS eroded {_DISK}", LAYER + ", " + _AB))
def mask_morphology(spark, sf_dir):
    a = _ab(spark, sf_dir).select("i", "j", "a")
    d = stencil.disk_extreme(stencil.disk_extreme(a, M, 2, "max", "a", "dilated"), M, 2, "min", "a", "eroded")
    return rounded(d.drop("a"))


def _mask_noise_sql() -> str:
    parts = {}
    for kind, stride in (("perlin", 1013), ("billow", 6151), ("ridged", 9173)):
        ctes, last = _octaves_sql(_PERLIN, 9, 0.13, 3, stride, 2.0, "i", "j")
        for o in range(3):
            ctes = re.sub(rf"\b(n{o}a|n{o}|m{o})\b", rf"{kind}_\1", ctes)
        parts[kind] = (ctes, f"{kind}_{last}")
    r = lambda o: f"(1 - abs({o})) * (1 - abs({o}))"
    return f"""WITH {_CELLS}, {', '.join(c for c, _ in parts.values())}, r0 AS (SELECT *, {r('o0')} AS s0 FROM {parts['ridged'][1]}), r1 AS (SELECT *, {r('o1')} * {clamp_sql('s0 * 2')} AS s1 FROM r0), r2 AS (SELECT *, {r('o2')} * {clamp_sql('s1 * 2')} AS s2 FROM r1)
      SELECT p.i, p.j, round({clamp_sql('(p.o0 + p.o1 * 0.5 + p.o2 * 0.25) / 1.75 * 0.5 + 0.5')}, 9) + 0.0 AS perlin, round({clamp_sql('(abs(b.o0) + abs(b.o1) * 0.5 + abs(b.o2) * 0.25) / 1.75')}, 9) + 0.0 AS billow, round({clamp_sql('(s0 + s1 * 0.5 + s2 * 0.25) / 1.75')}, 9) + 0.0 AS ridged
      FROM {parts['perlin'][1]} p JOIN {parts['billow'][1]} b USING (i, j) JOIN r2 USING (i, j)"""


@query("mask_noise", _mask_noise_sql())
def mask_noise(spark, sf_dir):
    out = source.cells(spark, M)
    for k in ("perlin", "billow", "ridged"):  # each a stage of its own: nine octaves outgrow what one generated method may hold
        let = noise.Let(source.cells(spark, M))
        n = noise.mask_noise(let, k, F.col("i"), F.col("j"), 9, 0.13)
        out = out.join(let.done(**{k: n}), ["i", "j"])
    return rounded(out)


def _water_sql(src: str, n: int) -> str:
    """One round over (i, j, h, w): what each cell hands on, and what it keeps with what comes from right and below."""
    flow = "CASE WHEN o.h + o.w < s.h + s.w THEN (s.h + s.w - o.h - o.w) * 0.7 * 0.2 ELSE 0 END"
    return f"""f{n} AS (SELECT s.i, s.j, s.w, o.i AS ti, o.j AS tj, {flow} AS d FROM {src} s JOIN {src} o ON abs(o.i - s.i) + abs(o.j - s.j) = 1),
      k{n} AS (SELECT i, j, ti, tj, d * CASE WHEN sum(d) OVER (PARTITION BY i, j) > w AND sum(d) OVER (PARTITION BY i, j) > 1e-6 THEN w / sum(d) OVER (PARTITION BY i, j) ELSE 1 END AS d FROM f{n}),
      w{n} AS (SELECT s.i, s.j, s.h, greatest(s.w - coalesce((SELECT sum(d) FROM k{n} x WHERE x.i = s.i AND x.j = s.j), 0), 0) + coalesce((SELECT sum(d) FROM k{n} x WHERE x.ti = s.i AND x.tj = s.j AND (x.i > s.i OR x.j > s.j)), 0) AS w FROM {src} s)"""


@query("standing_water", with_grid("SELECT i, j, round(h + CASE WHEN w > 1e-4 THEN w * 1.5 ELSE 0 END, 8) + 0.0 AS h, round(CASE WHEN w > 1e-4 THEN least(w / 2, 1) ELSE 0 END, 8) + 0.0 AS wet FROM w2", f"w0 AS (SELECT i, j, h, 2.0::DOUBLE AS w FROM g), {_water_sql('w0', 1)}, {_water_sql('w1', 2)}"))
def standing_water(spark, sf_dir):
    return rounded(hydrology.standing_water(grid(spark, sf_dir), 2.0, 0.3, 2, 1.5), digits=8)


# ------------------------------------------------------------------ shapes and soil

_UV = [(x / 320.0, z / 320.0) for x, z in _POLY]


def _uv_sql(points: list) -> str:
    """The distance and parity expressions read x and z; here these are u and v."""
    return f"{', '.join(_seg_sql(a, b) for a, b in zip(points, points[1:], strict=False))}"


def _uv_inside_sql() -> str:
    hits, (xj, yj) = [], _UV[-1]
    for xi, yi in _UV:
        hits.append(f"CASE WHEN ({yi} > z) <> ({yj} > z) AND x < {xj - xi!r}::DOUBLE * (z - {yi}) / {max(yj - yi, 1e-12)!r}::DOUBLE + {xi} THEN 1 ELSE 0 END")
        xj, yj = xi, yi
    return f"({' + '.join(hits)}) % 2 = 1"


@query("mask_shapes", f"WITH c AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j FROM range(32) a, range(32) b), s AS (SELECT i, j, (i + 0.5) / 32::DOUBLE AS x, (j + 0.5) / 32::DOUBLE AS z FROM c) SELECT i, j, round(CASE WHEN {_uv_inside_sql()} THEN 1 ELSE {clamp_sql(f'1 - least({_uv_sql([*_UV, _UV[0]])}) / 0.1')} END, 8) + 0.0 AS polygon, round({clamp_sql(f'1 - least({_uv_sql(_UV)}) / 0.08')}, 8) + 0.0 AS ribbon FROM s")
def mask_shapes(spark, sf_dir):
    c = source.cells(spark, M)
    u, v = (F.col("i") + 0.5) / 32, (F.col("j") + 0.5) / 32
    return rounded(c.select("i", "j", masks.polygon(u, v, _UV, 0.1).alias("polygon"), masks.ribbon(u, v, _UV, 0.08).alias("ribbon")), digits=8)


@query("soil_feedback", with_grid(f"SELECT i, j, round({clamp_sql('a * (1 - 0.6 * b)')}, 10) + 0.0 AS hardness, round(CASE WHEN b * 0.6 > 0.2 THEN 0.5 ELSE a END, 10) + 0.0 AS material, round(a + (1 - a) * 0.4 * b, 10) + 0.0 AS rooted FROM ab", LAYER + ", " + _AB))
def soil_feedback(spark, sf_dir):
    d = _ab(spark, sf_dir).select("i", "j", F.col("a").alias("hardness"), F.col("a").alias("material"), pointwise.root_cohesion(F.col("a"), F.col("b"), 0.4).alias("rooted"), "b")
    return rounded(reduce.mark_deposits(reduce.soften(d, "hardness", "b", 0.6), "material", "b", 0.6, 0.5).drop("b"), digits=10)


# ------------------------------------------------------------------ flagship

@query("grid_terrain_analysis", with_grid("SELECT n.i, n.j, n.h, round(degrees(atan(sqrt(((hr - n.h) / 10) ** 2 + ((hu - n.h) / 10) ** 2))), 8) + 0.0 AS slope, CAST(coalesce(k, 255) AS INT) AS dir FROM n JOIN f ON f.i = n.i AND f.j = n.j", _N4 + ", " + _FLOW))
def grid_terrain_analysis(spark, sf_dir):
    g = stencil.slope_forward(grid(spark, sf_dir), M)
    return rounded(hydrology.flow_direction(g).select("i", "j", "h", "slope", F.col("dir").cast("int").alias("dir")), "slope", digits=8)


