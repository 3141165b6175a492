"""Noise on numpy against noise as Columns, and field programs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.functions import lattice, noise
from gridweave.functions.program import Program, doubles, run
from gridweave.operators import effects
from gridweave.sources import grid, landforms

M = grid.Metrics(23, 17, 460.0, 340.0, tile=8)


@pytest.mark.parametrize("kind", ["perlin", "value", "simplex"])
def test_numpy_noise_equals_columns(spark, kind):
    df = spark.range(200).select(((F.col("id") - 90) * 0.37).alias("x"), ((F.col("id") % 13 - 6) * 1.19).alias("z"))
    let = noise.Let(df)
    (n,) = noise.KINDS[kind](let, [(F.col("x"), F.col("z"), 77 ^ 0xE06351D3)])
    rows = let.done(n=n).collect()
    x, z = (np.array([r[c] for r in rows]) for c in "xz")
    assert lattice.KINDS[kind](x, z, 77 ^ 0xE06351D3) == pytest.approx([r.n for r in rows], abs=1e-12)


def test_numpy_worley_equals_columns(spark):
    df = spark.range(100).select((F.col("id") * 0.37).alias("x"), (F.col("id") * 0.21 - 5).alias("z"))
    let = noise.Let(df)
    f1, f2 = noise.worley(let, F.col("x"), F.col("z"), 5)
    rows = let.done(a=f1, b=f2).collect()
    a, b = lattice.worley(np.array([r.x for r in rows]), np.array([r.z for r in rows]), 5)
    assert a == pytest.approx([r.a for r in rows]) and b == pytest.approx([r.b for r in rows])


def test_programs_match_fractals(spark):
    p = noise.Fractal(seed=9, frequency=0.02, octaves=3, amplitude=5.0)
    df = grid.with_world(grid.cells(spark, M), M)
    got = run(df, Program().fbm("a", "x", "z", p).ridged("b", "x", "z", p), "a", "b")
    let = noise.Let(df)
    want = let.done(a=noise.fbm(let, "perlin", F.col("x"), F.col("z"), p), b=noise.ridged(let, "perlin", F.col("x"), F.col("z"), p))
    rows = [{(r.i, r.j): (r.a, r.b) for r in d.collect()} for d in (got, want)]
    assert rows[0].keys() == rows[1].keys()
    assert all(rows[0][k] == pytest.approx(rows[1][k], abs=1e-9) for k in rows[0])


def test_decimals_become_doubles_once():
    assert doubles(doubles("a1.5 + 2.25 * 3 - 1e-5 + 0.5e0")) == doubles("a1.5 + 2.25 * 3 - 1e-5 + 0.5e0")
    assert doubles("x * 0.5") == "x * 0.5e0"


def test_landforms_do_not_depend_on_the_cells_asked_for(spark):
    whole = {(r.i, r.j): r.h for r in landforms.landform(grid.cells(spark, M), M, "canyons").collect()}
    part = landforms.landform(grid.cells(spark, M).where("i > 11 and j < 9"), M, "canyons").collect()
    assert part and all(whole[r.i, r.j] == r.h for r in part)


def test_islands_end_in_the_sea(spark):
    big = grid.Metrics(40, 40, 4000.0, 4000.0)
    rows = landforms.landform(grid.cells(spark, big), big, "island").collect()
    assert all(r.land == 0 and r.h < 0 for r in rows if r.i in (0, 39) or r.j in (0, 39))
    assert any(r.mountain > 0.2 for r in rows) and all((r.shore_distance < 0) == (r.land == 1) or abs(r.h) < 1e-6 for r in rows)


def test_sectors_hold_each_offset_once():
    for radius, sectors in ((1, 4), (2, 4), (3, 8)):
        got = [p for s in effects.sectors_of(radius, sectors) for p in s]
        assert len(got) == len(set(got)) == sum(0 < a * a + b * b <= radius * radius for a in range(-radius, radius + 1) for b in range(-radius, radius + 1))


def test_polygon_against_an_independent_test(spark):
    """Half-planes of the triangles that a star-shaped polygon is made of."""
    from gridweave.functions.math import in_polygon

    ring = [(0.1, 0.1), (0.5, 0.3), (0.9, 0.15), (0.65, 0.55), (0.8, 0.9), (0.45, 0.7), (0.15, 0.85), (0.3, 0.5)]
    centre = (0.5, 0.5)
    side = lambda p, a, b: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def inside(p):
        for a, b in zip(ring, ring[1:] + ring[:1]):
            s = [side(p, *e) for e in ((centre, a), (a, b), (b, centre))]
            if all(v >= 0 for v in s) or all(v <= 0 for v in s):
                return True
        return False

    points = [((k % 31) / 31 + 0.0137, (k // 31) / 31 + 0.0071) for k in range(31 * 31)]
    got = spark.createDataFrame(points, "x double, y double").select("x", "y", in_polygon(F.col("x"), F.col("y"), ring).alias("in")).collect()
    assert all(r["in"] == inside((r.x, r.y)) for r in got)
