"""Drainage that splits, basins that stay, and water that cuts: D-infinity, lakes, stream power and river beds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import clamp, col, stream_power_step
from ..sources.grid import Metrics
from ..sources.scratch import persisted
from .hydrology import D8, accumulate, around8, fill_depressions

#: Metres by which filling must raise a cell for it to count as part of a pit.
PIT = 1e-4
#: Least sum of weights that a facet may split.
LEAST = 1.1920928955078125e-07


def dinf_edges(df: DataFrame, m: Metrics) -> DataFrame:
    """Edges (i, j, ri, rj, fraction): flow down the steepest of the eight facets around a cell.

    A facet is the plane through the cell and two neighbours in turn. If it falls
    between the two, both get a share, by how far the descent leans to each;
    otherwise the steeper edge takes all. Cells without a way down have no edge;
    ties go to the first facet. Two windows and projections, no self-join.
    """
    ways = [(di * m.dx, dj * m.dz) for di, dj in D8]
    d = around8(df)
    facets: dict[str, Column] = {}
    for k in range(8):
        (ax, az), (bx, bz) = ways[k], ways[(k + 1) % 8]
        det, la, lb = ax * bz - az * bx, math.sqrt(ax * ax + az * az), math.sqrt(bx * bx + bz * bz)
        za, zb = F.col(f"n{k}") - F.col("h"), F.col(f"n{(k + 1) % 8}") - F.col("h")
        facets |= {f"__gx{k}": (za * bz - zb * az) / det, f"__gz{k}": (zb * ax - za * bx) / det}
        d = d.withColumns({c: facets[c] for c in (f"__gx{k}", f"__gz{k}")})
        gx, gz = F.col(f"__gx{k}"), F.col(f"__gz{k}")
        lean_a, lean_b = (gz * bx - gx * bz) / det, (gx * az - gz * ax) / det
        wa = F.when(za < 0, F.greatest(lean_a, F.lit(0.0)) * la).otherwise(0.0)
        wb = F.when(zb < 0, F.greatest(lean_b, F.lit(0.0)) * lb).otherwise(0.0)
        between = (lean_a >= -1e-6) & (lean_b >= -1e-6) & (wa + wb > LEAST)
        sa, sb = F.greatest(-za / la, F.lit(0.0)), F.greatest(-zb / lb, F.lit(0.0))
        # a facet beyond the edge has a null slope and is passed over
        d = d.withColumns({
            f"__s{k}": F.when(za.isNull() | zb.isNull(), 0.0).when(between, F.sqrt(gx * gx + gz * gz)).otherwise(F.greatest(sa, sb)),
            f"__a{k}": F.when(between, wa / (wa + wb)).otherwise(F.when(sa >= sb, 1.0).otherwise(0.0)),
        })
    top, best = F.greatest(*(F.col(f"__s{k}") for k in range(8))), F.lit(None)
    for k in reversed(range(8)):
        a, b = D8[k], D8[(k + 1) % 8]
        edges = F.array(*(F.struct((F.col("i") + di).alias("ri"), (F.col("j") + dj).alias("rj"), part.alias("fraction")) for (di, dj), part in ((a, F.col(f"__a{k}")), (b, 1.0 - F.col(f"__a{k}")))))
        best = F.when((F.col(f"__s{k}") == top) & (top > 0), edges).otherwise(best)
    return d.select("i", "j", F.inline(best)).where("fraction > 0")


def drain(df: DataFrame, edges: DataFrame, rain: Column | float = 1.0, max_rounds: int = 100_000) -> DataFrame:
    """area: rain of a cell and of all that drains through it, along edges (i, j, ri, rj, fraction) without a cycle.

    A round hands what arrived one edge on: an equi-join and a sum that combines
    on the map side. It takes as many rounds as the longest path; only cells that
    water just reached take part.
    """
    e = persisted(edges)
    state = persisted(df.select("i", "j", (rain if isinstance(rain, Column) else F.lit(float(rain))).alias("w")))
    parts, held = [state], None
    for _ in range(max_rounds):
        moved = state.join(e, ["i", "j"]).groupBy(F.col("ri").alias("i"), F.col("rj").alias("j")).agg(F.sum(F.col("w") * F.col("fraction")).alias("w"))
        state = persisted(moved)
        if state.isEmpty():
            break
        parts.append(state)
        if len(parts) == 32:  # keeps the plan of the total short
            held = persisted(_total(parts))
            parts = [held]
    else:
        raise RuntimeError("a flow path is longer than max_rounds")
    return df.join(_total(parts).withColumnRenamed("w", "area"), ["i", "j"])


def _total(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.groupBy("i", "j").agg(F.sum("w").alias("w"))


def pits(df: DataFrame, m: Metrics, max_rounds: int = 1000) -> DataFrame:
    """Cells that filling raises: i, j, h, filled, pit (the least cell number of its 8-connected region).

    Labels sink to the least of the neighbourhood, then jump to their label's
    label, so a region of n cells settles in about log n rounds.
    """
    filled = fill_depressions(df.select("i", "j", "h"), m).withColumnRenamed("h", "filled")
    low = df.select("i", "j", "h").join(filled, ["i", "j"]).where(F.col("filled") - F.col("h") > PIT)
    state = persisted(low.withColumn("cell", F.col("j").cast("long") * m.width + F.col("i")).withColumn("pit", F.col("cell")))
    ways = F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in ((0, 0), *D8)))
    for _ in range(max_rounds):
        said = state.select("i", "j", "pit", F.inline(ways)).groupBy((F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")).agg(F.min("pit").alias("least"))
        near = state.join(said, ["i", "j"])
        jump = persisted(near.select("i", "j", "h", "filled", "cell", "pit", "least"))
        to = jump.select(F.col("cell").alias("least"), F.col("least").alias("further"))
        nxt = persisted(jump.join(to, "least").select("i", "j", "h", "filled", "cell", F.least("least", "further").alias("pit"), (F.least("least", "further") < F.col("pit")).alias("moved")))
        state = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return state.drop("cell")
    raise RuntimeError("pits did not settle")


def preserve_basins(df: DataFrame, m: Metrics, min_depth: float, min_cells: int) -> DataFrame:
    """Pits filled but for those at least that deep and large: h, raised (metres) and lake (1 in what stays)."""
    p = pits(df, m)
    size = p.groupBy("pit").agg((F.max(F.col("filled") - F.col("h"))).alias("deep"), F.count(F.lit(1)).alias("cells"))
    p = p.join(size, "pit").select("i", "j", "filled", ((F.col("deep") >= min_depth) & (F.col("cells") >= min_cells)).alias("stays"))
    d = df.join(p, ["i", "j"], "left")
    fill = F.coalesce(~F.col("stays"), F.lit(False))
    raised = F.when(fill, F.col("filled") - F.col("h")).otherwise(0.0)
    return d.select(*(c for c in df.columns if c != "h"), F.when(fill, F.col("filled")).otherwise(F.col("h")).alias("h"), raised.alias("raised"), F.coalesce(F.col("stays").cast("double"), F.lit(0.0)).alias("lake"))


def steepest(df: DataFrame) -> Column:
    """Over the columns of around8: the largest drop for a cell step, 0 for none."""
    return F.greatest(F.lit(0.0), *((F.col("h") - F.col(f"n{k}")) / (math.sqrt(2.0) if di and dj else 1.0) for k, (di, dj) in enumerate(D8)))


def stream_power(df: DataFrame, m: Metrics, k: float, m_exp: float = 0.5, n_exp: float = 1.0, dt: float = 1.0, iterations: int = 1, hardness: str | None = None, uplift: float = 0.0, base: float = -math.inf, refill: bool = False, dinf: bool = False) -> DataFrame:
    """h cut by K A^m S^n, incision (metres, summed) and area (cells, of the last round).

    Each round routes on the surface, filled in the first and, with refill, in
    all: area from D8 or D-infinity, slope the steepest drop for a cell step. A
    step is at most twice that slope and 50 m, and none goes below base. hardness
    names a column in [0, 1]; 1 is not cut.
    """
    soft = 1.0 - clamp(col(hardness)) if hardness else F.lit(1.0)
    state = persisted(df.withColumn("incision", F.lit(0.0)))
    cell = max(m.dx * m.dz, 1e-6)
    for n in range(max(1, iterations)):
        ground = state.select("i", "j", "h")
        route = persisted(fill_depressions(ground, m)) if refill or n == 0 else ground
        slopes = around8(route)
        slopes = slopes.select("i", "j", F.greatest(steepest(slopes), F.lit(1e-6)).alias("__s"))
        area = drain(route, dinf_edges(route, m)) if dinf else accumulate(route)
        d = state.drop("area").join(area.select("i", "j", "area"), ["i", "j"]).join(slopes, ["i", "j"])
        _, step = stream_power_step(F.greatest(F.col("area") * cell, F.lit(cell)), F.col("__s"), k, m_exp, n_exp, soft, dt, F.col("__s") * 2.0, 50.0)
        d = d.withColumn("__h", F.greatest(F.col("h") - step + uplift, F.lit(base)))
        cut = F.col("incision") + F.greatest(F.col("h") - F.col("__h"), F.lit(0.0))
        state = persisted(d.select(*(c for c in df.columns if c != "h"), F.col("__h").alias("h"), cut.alias("incision"), "area"))
    return state


def carve_rivers(df: DataFrame, m: Metrics, threshold: float, width: float, depth: float, bank: float = 0.0, dinf: bool = False) -> DataFrame:
    """h with beds cut around cells whose drainage reaches threshold, wetness, and accumulation over its largest.

    A channel cell spreads a bell around itself, wider and deeper by its drainage
    (by two at most in depth, four in width), so what it reaches is bounded by
    width and not by the grid; cuts add up, wetness is the largest.
    """
    route = persisted(fill_depressions(df.select("i", "j", "h"), m))
    area = persisted((drain(route, dinf_edges(route, m)) if dinf else accumulate(route)).select("i", "j", "area"))
    most = max(area.agg(F.max("area")).first()[0] or 1.0, 1.0)
    scale = F.greatest(F.lit(1.0), F.least(F.lit(4.0), F.sqrt(F.col("area") / threshold)))
    c = area.where(F.col("area") >= threshold).select("i", "j", scale.alias("s")).withColumn("w", F.lit(max(width, 1.0)) * F.col("s"))
    c = c.withColumns({"reach": F.col("w") * (1.0 + bank * 0.75), "sigma": F.col("w") * max(0.35 + bank * 0.2, 0.1)})
    r = F.ceil("reach").cast("int")
    c = c.withColumn("di", F.explode(F.sequence(-r, r))).withColumn("dj", F.explode(F.sequence(-r, r))).withColumn("q", F.sqrt((F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).cast("double"))).where("q <= reach")
    c = c.withColumn("bell", F.exp(-0.5 * F.col("q") / F.col("sigma") * (F.col("q") / F.col("sigma"))))
    at = [(F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j")]
    cut = c.groupBy(*at).agg(F.sum(depth * F.sqrt("s") * F.col("bell")).alias("__cut"), F.max(clamp(F.col("bell") * F.sqrt("s") * 0.85)).alias("wetness"))
    out = df.join(area, ["i", "j"]).join(cut, ["i", "j"], "left")
    return out.select(*(x for x in df.columns if x != "h"), (F.col("h") - F.coalesce("__cut", F.lit(0.0))).alias("h"), F.coalesce("wetness", F.lit(0.0)).alias("wetness"), (F.col("area") / most).alias("accumulation"))
