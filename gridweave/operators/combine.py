"""Where grids meet: composites, resampling, lookups by range, and set operations on tiles."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blend import blend
from ..functions.math import clamp
from ..sources.grid import Metrics, cells

KEY = ["i", "j"]


def composite(base: DataFrame, layer: DataFrame, mode: str, opacity: float = 1.0, mask: DataFrame | None = None) -> DataFrame:
    """base.h with layer.h blended over it where mask.w says; an equi-join on the cell."""
    d = base.join(layer.select(*KEY, F.col("h").alias("__layer")), KEY)
    w: Column | float = 1.0
    if mask is not None:
        d, w = d.join(mask.select(*KEY, F.col("w").alias("__w")), KEY), F.col("__w")
    return d.withColumn("h", blend(mode, F.col("h"), F.col("__layer"), opacity, w)).select(*base.columns)


def merge_delta(parent: DataFrame, shared: DataFrame, result: DataFrame, mask: DataFrame, opacity: float = 1.0) -> DataFrame:
    """parent + weight * (result - shared)."""
    d = parent.join(shared.select(*KEY, F.col("h").alias("__s")), KEY).join(result.select(*KEY, F.col("h").alias("__r")), KEY).join(mask.select(*KEY, F.col("w").alias("__w")), KEY)
    return d.withColumn("h", F.col("h") + clamp(F.col("__w") * opacity) * (F.col("__r") - F.col("__s"))).select(*parent.columns)


def merge_fields(parent: DataFrame, child: DataFrame, mask: DataFrame, opacity: float = 1.0) -> DataFrame:
    """(i, j, field, value): the child's fields over the parent's by mask; what the parent lacks counts as 0."""
    p, c = (x.select(*KEY, "field", F.col("value").alias(n)) for x, n in ((parent, "__p"), (child, "__c")))
    d = p.join(c, [*KEY, "field"], "full").join(mask.select(*KEY, F.col("w").alias("__w")), KEY, "left")
    w = clamp(F.coalesce("__w", F.lit(0.0)) * opacity)
    before = F.coalesce("__p", F.lit(0.0))
    return d.select(*KEY, "field", F.when(F.col("__c").isNull(), before).otherwise(before * (1.0 - w) + F.col("__c") * w).alias("value"))


def override_fields(base: DataFrame, other: DataFrame) -> DataFrame:
    """Union of (i, j, field, value) in which the second table wins."""
    a, b = (x.select(*KEY, "field", F.col("value").alias(n)) for x, n in ((base, "__a"), (other, "__b")))
    return a.join(b, [*KEY, "field"], "full").select(*KEY, "field", F.coalesce("__b", "__a").alias("value"))


def resample_nearest(df: DataFrame, source: Metrics, target: Metrics, value: str = "h") -> DataFrame:
    """The source cell under each target cell's centre."""
    at = lambda k, n, size: F.least(F.floor((F.col(k) + 0.5) / n * size), F.lit(size - 1)).cast("int")
    d = cells(df.sparkSession, target).withColumns({"si": at("i", target.width, source.width), "sj": at("j", target.height, source.height)})
    src = df.select(F.col("i").alias("si"), F.col("j").alias("sj"), value)
    return d.join(src, ["si", "sj"]).select(*KEY, value)


def downsample(df: DataFrame, source: Metrics, target: Metrics, value: str = "h") -> DataFrame:
    """Area mean. Each source cell goes to the one or two target cells that it overlaps on each axis."""

    def parts(k: str, n: int, size: int) -> Column:
        scale = size / n
        lo, hi = F.col(k) * scale, (F.col(k) + 1) * scale
        first = F.floor(lo).cast("int")
        last = F.least(F.ceil(hi - 1e-9) - 1, F.lit(size - 1)).cast("int")
        return F.transform(F.sequence(first, last), lambda t: F.struct(t.alias("at"), (F.least(hi, (t + 1).cast("double")) - F.greatest(lo, t.cast("double"))).alias("share")))

    d = df.select(F.explode(parts("i", source.width, target.width)).alias("a"), "j", value).select("a", F.explode(parts("j", source.height, target.height)).alias("b"), value)
    w = F.col("a.share") * F.col("b.share")
    return d.groupBy(F.col("a.at").alias("i"), F.col("b.at").alias("j")).agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))


def upsample(df: DataFrame, source: Metrics, target: Metrics, value: str = "h") -> DataFrame:
    """Bilinear, with clamped edges. Each target cell asks for its four corners, which join on their cells."""
    u = (F.col("i") + 0.5) / target.width * source.width - 0.5
    v = (F.col("j") + 0.5) / target.height * source.height - 0.5
    d = cells(df.sparkSession, target).withColumns({"fu": u - F.floor(u), "fv": v - F.floor(v), "iu": F.floor(u).cast("int"), "iv": F.floor(v).cast("int")})
    corner = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for b in (0, 1) for a in (0, 1)))
    d = d.withColumn("c", F.explode(corner))
    hold = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1))
    share = F.when(F.col("c.a") == 1, F.col("fu")).otherwise(1.0 - F.col("fu")) * F.when(F.col("c.b") == 1, F.col("fv")).otherwise(1.0 - F.col("fv"))
    d = d.select(*KEY, share.alias("share"), hold(F.col("iu") + F.col("c.a"), source.width).alias("si"), hold(F.col("iv") + F.col("c.b"), source.height).alias("sj"))
    src = df.select(F.col("i").alias("si"), F.col("j").alias("sj"), value)
    return d.join(src, ["si", "sj"]).groupBy(*KEY).agg(F.sum(F.col(value) * F.col("share")).alias(value))


def gather(df: DataFrame, si: Column, sj: Column, m: Metrics, value: str = "h") -> DataFrame:
    """Each cell's value replaced by that of the cell (si, sj), clamped to the grid."""
    hold = lambda x, n: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1)).cast("int")
    src = df.select(F.col("i").alias("si"), F.col("j").alias("sj"), F.col(value).alias("__v"))
    return df.withColumns({"si": hold(si, m.width), "sj": hold(sj, m.height)}).join(src, ["si", "sj"]).withColumn(value, F.col("__v")).select(*df.columns)


def lookup_band(df: DataFrame, depth: str, thickness: Sequence[float], values: Sequence[float], fallback: float) -> Column:
    """The value of the layer that holds a depth, by running thickness; fallback for no layers, the last below all."""
    if not thickness:
        return F.lit(fallback)
    out, bottom = F.lit(values[-1]), sum(thickness)
    for t, v in reversed(list(zip(thickness, values, strict=True))):
        out = F.when(F.col(depth) < bottom, v).otherwise(out)
        bottom -= t
    return out


def classify(df: DataFrame, bands: DataFrame, bounds: Sequence[tuple[str, str, str]], out: str, default: int = 0) -> DataFrame:
    """The id of the last band (by ord) all of whose (value, low, high) bounds hold.

    bands is a small rule table, at most 1000 rows, folded on the driver into one
    ordered expression; cells are not joined to rules.
    """
    rules = bands.orderBy("ord").limit(1001).collect()
    if len(rules) > 1000:
        raise ValueError("a rule table holds at most 1000 bands")
    found = F.lit(default)
    for r in rules:
        ok = F.lit(True)
        for value, low, high in bounds:
            ok = ok & F.col(value).between(r[low], r[high])
        found = F.when(ok, r["id"]).otherwise(found)
    return df.withColumn(out, found)


def tile_digests(df: DataFrame, m: Metrics, value: str = "h") -> DataFrame:
    """tx, tz, digest: an order-free digest of each tile's cells, combined on the map side."""
    cell = F.xxhash64("i", "j", value).cast("decimal(38,0)")
    d = df.withColumns({"tx": F.expr(f"cast(i div {m.tile} as int)"), "tz": F.expr(f"cast(j div {m.tile} as int)")})
    return d.groupBy("tx", "tz").agg(F.sum(cell).cast("string").alias("digest"), F.count(F.lit(1)).alias("cells"))


def changed_tiles(previous: DataFrame, current: DataFrame, digest: str = "digest") -> DataFrame:
    """Tiles of current without an equal one in previous."""
    return current.join(previous.select("tx", "tz", digest), ["tx", "tz", digest], "left_anti").select("tx", "tz")


def spread_tiles(tiles: DataFrame, m: Metrics, radius: int) -> DataFrame:
    """The listed tiles and those within radius of them, inside the grid."""
    nx, nz = -(-m.width // m.tile), -(-m.height // m.tile)
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    d = tiles.select("tx", "tz").distinct().withColumn("a", F.explode(steps)).withColumn("b", F.explode(steps))
    d = d.select((F.col("tx") + F.col("a")).alias("tx"), (F.col("tz") + F.col("b")).alias("tz"))
    return d.where(F.col("tx").between(0, nx - 1) & F.col("tz").between(0, nz - 1)).distinct()


def tile_bounds(tiles: DataFrame, m: Metrics, pad: int = 0) -> DataFrame:
    """The smallest rectangle of cells around the tiles, with pad cells, inside the grid."""
    b = tiles.agg(F.min("tx").alias("a"), F.min("tz").alias("b"), F.max("tx").alias("c"), F.max("tz").alias("d"))
    return b.select(F.greatest(F.col("a") * m.tile - pad, F.lit(0)).alias("i0"), F.greatest(F.col("b") * m.tile - pad, F.lit(0)).alias("j0"), F.least((F.col("c") + 1) * m.tile + pad, F.lit(m.width)).alias("i1"), F.least((F.col("d") + 1) * m.tile + pad, F.lit(m.height)).alias("j1"))


def finest_ancestor(requests: DataFrame, pages: DataFrame, tile: int) -> DataFrame:
    """Requests (level, i, j) with the finest level at or above theirs whose page (level, tx, tz) exists.

    An as-of lookup on level: each request lists its own candidates, one for each
    coarser level, which meet the pages by equality.
    """
    scale = lambda k, lv: F.floor(F.col(k) / F.pow(F.lit(2.0), (F.col("level") - lv).cast("double"))).cast("int")
    d = requests.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("level"))))
    d = d.withColumns({"si": scale("i", F.col("at")), "sj": scale("j", F.col("at"))}).withColumns({"px": F.expr(f"cast(si div {tile} as int)"), "pz": F.expr(f"cast(sj div {tile} as int)")})
    p = pages.select(F.col("level").alias("at"), F.col("tx").alias("px"), F.col("tz").alias("pz"))
    return d.join(p, ["at", "px", "pz"]).groupBy("level", "i", "j").agg(F.max("at").alias("found"))


def first_ids(df: DataFrame, m: Metrics, value: str, most: int = 4) -> DataFrame:
    """The first few distinct ids that are not 0, in scan order."""
    seen = df.where(F.col(value) != 0).groupBy(F.col(value).alias("id")).agg(F.min(F.col("j").cast("long") * m.width + F.col("i")).alias("at"))
    return seen.orderBy("at").limit(most).withColumn("slot", F.row_number().over(Window.orderBy("at")) - 1).select("slot", "id")


def tiles_of_rect(m: Metrics, min_u: float, min_v: float, max_u: float, max_v: float) -> list[tuple[int, int]]:
    """(tx, tz) of the tiles that a rectangle in [0, 1] touches, at least one; all if a corner is not a number."""
    if not all(map(math.isfinite, (min_u, min_v, max_u, max_v))):
        spans = [(0, m.width), (0, m.height)]
    else:
        unit = lambda t: min(max(t, 0.0), 1.0)
        starts = [(min(math.floor(unit(lo) * n), n - 1), math.ceil(unit(hi) * n), n) for lo, hi, n in ((min_u, max_u, m.width), (min_v, max_v, m.height))]
        spans = [(a, min(max(b, a + 1), n)) for a, b, n in starts]
    (a, b), (c, d) = spans
    return [(tx, tz) for tz in range(c // m.tile, (d - 1) // m.tile + 1) for tx in range(a // m.tile, (b - 1) // m.tile + 1)]
