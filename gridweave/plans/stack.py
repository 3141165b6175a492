"""Layer documents: an ordered tree of layers and groups, evaluated as one logical plan.

A document is JSON: {"nodes": [...]}; a node is a layer {"kind", "params",
"blend", "opacity", "mask", "enabled"} or a group {"group": [...], ...} whose
result is blended like a layer's. Layers that only read their own cell become
projections that Catalyst fuses; others add their windows. Nothing runs until
the result is used.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, noise
from ..functions.blend import blend
from ..functions.math import clamp, span
from ..operators import effects, filters, hydrology, pointwise, rock, stencil  # noqa: F401  (effects and rock name their filters)
from ..sources import landforms
from ..sources.grid import Metrics, cells, ramp, with_world

#: How a kind blends where a layer does not say.
ADDED = frozenset({"noise_value", "noise_perlin", "noise_simplex", "noise_worley", "fbm", "ridged", "domain_warp", "voronoi_regions"})


def _sampled(sample: Callable[..., Column]):
    def run(df: DataFrame, m: Metrics, p: dict) -> DataFrame:
        let = noise.Let(with_world(df, m))
        return let.done(h=sample(let, F.col("x"), F.col("z"), p)).select(*df.columns)

    return run


def _fractal(p: dict) -> noise.Fractal:
    return noise.Fractal(**{k: v for k, v in p.items() if k in noise.Fractal.__dataclass_fields__})


def _field(kind: str):
    """Noise of one octave times amplitude, or fBm of several."""

    def sample(let, x, z, p):
        f = _fractal(p)
        if f.octaves > 1:
            return noise.fbm(let, kind, x, z, f)
        return noise.KINDS[kind](let, f.samples(x, z, 0))[0] * f.amplitude

    return _sampled(sample)


def _regions(let, x, z, p):
    f = _fractal(p)
    (v,) = noise.value(let, [((x + f.offset_x) * f.frequency, (z + f.offset_z) * f.frequency, f.seed ^ 0xBEEF)])
    return noise.cell_feature(let, x, z, f) * 0.25 + v * p.get("height_per_cell", 40.0) * p.get("cell_jitter", 1.0)


def _blur(df: DataFrame, m: Metrics, p: dict) -> DataFrame:
    return stencil.shrinking_mean(df, p.get("radius", 1), p.get("iterations", 1))


def _landform(kind: str):
    """Heights of a landform in place of the grid's."""
    return lambda df, m, p: landforms.landform(df.select("i", "j"), m, kind, **p).select("i", "j", "h")


#: Layer kinds of a procedural shape's generators.
SHAPES = {"mountain": "mountains", "hills": "fbm", "plateau": "plateau", "mesa": "mesa", "volcano": "volcano", "dunes": "dune_sand", "canyon": "canyons", "crater": "crater", "noise": "noise_perlin"}


LAYERS: dict[str, Callable[[DataFrame, Metrics, dict], DataFrame]] = {
    "flat": lambda df, m, p: df.withColumn("h", F.lit(float(p.get("height", 0.0)))),
    "ramp": lambda df, m, p: ramp(df.drop("h"), m, p.get("direction", 0.0), p.get("height_min", 0.0), p.get("height_max", 100.0)).select(*df.columns),
    "noise_value": _field("value"),
    "noise_perlin": _field("perlin"),
    "noise_simplex": _field("simplex"),
    "noise_worley": _sampled(lambda let, x, z, p: noise.cell_feature(let, x, z, _fractal(p), p.get("feature", "f1"), p.get("metric", "euclidean"))),
    "fbm": _sampled(lambda let, x, z, p: noise.fbm(let, p.get("noise", "perlin"), x, z, _fractal(p))),
    "ridged": _sampled(lambda let, x, z, p: noise.ridged(let, p.get("noise", "perlin"), x, z, _fractal(p))),
    "domain_warp": _sampled(lambda let, x, z, p: noise.domain_warp(let, x, z, _fractal(p), p.get("warp_strength", 40.0), p.get("warp_frequency", 0.01))),
    "voronoi_regions": _sampled(_regions),
    **{kind: _landform(kind) for kind in landforms.LANDFORMS},
    "procedural_shape": lambda df, m, p: LAYERS[SHAPES[p.get("generator", "mountain")]](df, m, p.get("params", {})),
    "plateau": lambda df, m, p: df.withColumn("h", pointwise.plateau(F.col("h"), p["low"], p["high"], p.get("soft", 1.0))),
    "coastal": lambda df, m, p: df.withColumn("h", pointwise.coastal(F.col("h"), p["sea_level"], p["beach_width"], p.get("shelf_depth", 0.0), p.get("flatten_below", True))),
    "blur": _blur,
    "thermal_erosion": lambda df, m, p: hydrology.thermal(df, m, p.get("talus_angle_deg", 32.0), p.get("strength", 0.5), p.get("iterations", 4), 1.0 - p.get("hardness", 0.0)),
    "polygon_height": lambda df, m, p: pointwise.polygon_height(df, m, [tuple(q) for q in p["points"]], p.get("height", 10.0), p.get("falloff", 0.05), p.get("carve", False), p.get("set_elevation", False)),
    "crater": lambda df, m, p: filters.apply(df.withColumn("h", F.lit(0.0)), m, "crater", filters.Options(**p)),
    "effect_filter": lambda df, m, p: filters.apply(df, m, p["filter"], filters.Options(**{k: v for k, v in p.items() if k != "filter"})),
}


def mask_column(rules: list[dict]) -> Column:
    """A layer's mask from rules on its cell: height spans, levels and constants, combined in order."""
    made = {
        "constant": lambda r: F.lit(float(r["value"])),
        "height": lambda r: span(F.col("h"), r["min"], r["max"]),
        "above": lambda r: masks.above(F.col("h"), r["at"], r.get("falloff", 1.0)),
        "below": lambda r: masks.below(F.col("h"), r["at"], r.get("falloff", 1.0)),
        "sea_level": lambda r: masks.sea_level(F.col("h"), r["level"], r["width"]),
    }
    out: Column = F.lit(1.0)
    for r in rules:
        m = clamp(made[r["source"]](r))
        m = 1.0 - m if r.get("invert") else m
        out = masks.COMBINES[r.get("combine", "multiply")](out, clamp(m * r.get("strength", 1.0)))
    return out


def evaluate(spark: SparkSession, m: Metrics, document: str | dict, start: DataFrame | None = None) -> DataFrame:
    """(i, j, h) of a document over a start grid, level 0 where none is given; its nodes bottom to top."""
    doc = json.loads(document) if isinstance(document, str) else document
    state = start if start is not None else cells(spark, m).withColumn("h", F.lit(0.0))
    return _nodes(state, m, doc["nodes"])


def _nodes(state: DataFrame, m: Metrics, nodes: list[dict]) -> DataFrame:
    for n in nodes:
        if not n.get("enabled", True):
            continue
        if "group" in n:
            base = state.withColumn("h", F.lit(0.0)) if n.get("isolated", True) else state
            made, mode = _nodes(base, m, n["group"]), n.get("blend", "add" if n.get("isolated", True) else "normal")
        else:
            made, mode = LAYERS[n["kind"]](state, m, n.get("params", {})), n.get("blend", "add" if n["kind"] in ADDED else "normal")
        w = mask_column(n.get("masks", []))
        if mode in ("normal", "replace") and n.get("opacity", 1.0) >= 1.0 and not n.get("masks"):
            state = made
            continue
        both = state.join(made.select("i", "j", F.col("h").alias("__layer")), ["i", "j"])
        state = both.withColumn("h", blend(mode, F.col("h"), F.col("__layer"), n.get("opacity", 1.0), w)).select(*state.columns)
    return state
