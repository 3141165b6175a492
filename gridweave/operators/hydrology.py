"""Drainage and relaxation on grids: edge relations, pointer jumping and fixpoints.

Cells are keyed by (i, j); a flow graph is the relation of cells and receivers.
Iterations write their state to the session's shared folder every few rounds, so
a lost executor costs a reread and no plan grows with the number of rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import clamp
from ..sources.grid import Metrics
from ..sources.scratch import persisted
from .stencil import along_i, along_j, near4

#: East, south-east, south, south-west, west, north-west, north, north-east as (di, dj). Fixed order: ties go to the first.
D8 = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))

def around8(df: DataFrame, value: str = "h") -> DataFrame:
    """n0 .. n7: the eight neighbours in the order of D8, null beyond the edge; two windows."""
    c = F.col(value)
    d = df.withColumns({"__s": F.lead(c).over(along_j()), "__n": F.lag(c).over(along_j())})
    rows = {-1: "__n", 0: value, 1: "__s"}
    pick = {}
    for k, (di, dj) in enumerate(D8):
        own = F.col(rows[dj])
        pick[f"n{k}"] = own if di == 0 else F.lead(own).over(along_i()) if di > 0 else F.lag(own).over(along_i())
    return d.withColumns(pick).drop("__s", "__n")


def flow_direction(df: DataFrame) -> DataFrame:
    """dir: number of the steepest lower neighbour in D8, diagonals over the square root of 2; 255 for none."""
    d = around8(df)
    at = F.lit(255)
    slopes = {f"__d{k}": (F.col("h") - F.col(f"n{k}")) / (math.sqrt(2.0) if di and dj else 1.0) for k, (di, dj) in enumerate(D8)}
    d = d.withColumns(slopes)
    top = F.greatest(*(F.coalesce(F.col(f"__d{k}"), F.lit(-1.0)) for k in range(8)))
    d = d.withColumn("__top", top)
    for k in reversed(range(8)):
        at = F.when((F.col("__top") > 1e-12) & (F.col(f"__d{k}") >= F.col("__top") - 1e-12), k).otherwise(at)
    return d.withColumn("dir", at).select(*df.columns, "dir")


def receivers(df: DataFrame) -> DataFrame:
    """ri, rj: the receiver of each cell, null for a sink."""
    step = F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di, dj in D8))
    d = flow_direction(df).withColumn("__s", F.when(F.col("dir") < 8, F.element_at(step, F.col("dir").cast("int") + 1)))
    return d.withColumns({"ri": F.col("i") + F.col("__s.di"), "rj": F.col("j") + F.col("__s.dj")}).drop("__s")


def accumulate(df: DataFrame, rain: Column | float = 1.0, max_rounds: int = 64) -> DataFrame:
    """area: rain of all cells whose flow passes a cell, itself included.

    Path doubling: after k rounds each cell has sent its rain 2^k cells down, so
    a path of n cells takes log2 n rounds instead of n; every round is two
    equi-joins and a sum that combines on the map side.
    """
    base = receivers(df).withColumn("__rain", rain if isinstance(rain, Column) else F.lit(float(rain)))
    state = persisted(base.select("i", "j", F.col("__rain").alias("area"), "ri", "rj"))
    for _ in range(max_rounds):
        if state.where("ri is not null").isEmpty():
            break
        arrived = state.where("ri is not null").groupBy(F.col("ri").alias("i"), F.col("rj").alias("j")).agg(F.sum("area").alias("in"))
        hop = state.select(F.col("i").alias("hi"), F.col("j").alias("hj"), F.col("ri").alias("r2i"), F.col("rj").alias("r2j"))
        nxt = state.join(arrived, ["i", "j"], "left").join(hop, (F.col("ri") == F.col("hi")) & (F.col("rj") == F.col("hj")), "left")
        state = persisted(nxt.select("i", "j", (F.col("area") + F.coalesce("in", F.lit(0.0))).alias("area"), F.col("r2i").alias("ri"), F.col("r2j").alias("rj")))
    else:
        raise RuntimeError("a flow path is longer than 2**max_rounds")
    return df.join(state.select("i", "j", "area"), ["i", "j"])


def watersheds(df: DataFrame, max_rounds: int = 64) -> DataFrame:
    """oi, oj: the outlet that each cell drains to, by pointer jumping in log2 of the longest path."""
    base = receivers(df)
    state = persisted(base.select("i", "j", F.coalesce("ri", "i").alias("oi"), F.coalesce("rj", "j").alias("oj")))
    for _ in range(max_rounds):
        hop = state.select(F.col("i").alias("hi"), F.col("j").alias("hj"), F.col("oi").alias("o2i"), F.col("oj").alias("o2j"))
        nxt = persisted(state.join(hop, (F.col("oi") == F.col("hi")) & (F.col("oj") == F.col("hj"))).select("i", "j", F.col("o2i").alias("oi"), F.col("o2j").alias("oj"), ((F.col("oi") != F.col("o2i")) | (F.col("oj") != F.col("o2j"))).alias("moved")))
        state = nxt.select("i", "j", "oi", "oj")
        if nxt.where("moved").isEmpty():
            break
    return df.join(state, ["i", "j"])


def watershed_sizes(df: DataFrame) -> DataFrame:
    return watersheds(df).groupBy("oi", "oj").agg(F.count(F.lit(1)).alias("cells"))


def outlets(df: DataFrame) -> DataFrame:
    """Cells without a receiver."""
    return receivers(df).where("ri is null").select("i", "j")


def boundaries(df: DataFrame, label: str) -> DataFrame:
    """edge: 1 at the grid's edge and where a 4-neighbour's label differs."""
    c, out = F.col(label), F.lit(False)
    d = df.withColumns({"__a": F.lag(c).over(along_j()), "__b": F.lead(c).over(along_j())}).withColumns({"__c": F.lag(c).over(along_i()), "__d": F.lead(c).over(along_i())})
    for n in ("__a", "__b", "__c", "__d"):
        out = out | ~c.eqNullSafe(F.col(n))
    return d.withColumn("edge", out.cast("double")).drop("__a", "__b", "__c", "__d")


def fill_depressions(df: DataFrame, m: Metrics, max_rounds: int = 1000, every: int = 8) -> DataFrame:
    """h raised until every cell can drain to the edge.

    The least fixpoint of max(ground, lowest neighbour): inner cells start at
    the top and sink, rounds of eight stencils at a time, until none moves.
    """
    top = df.agg(F.max("h")).first()[0]
    at_edge = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == m.width - 1) | (F.col("j") == m.height - 1)
    state = df.select("i", "j", F.col("h").alias("ground"), F.when(at_edge, F.col("h")).otherwise(F.lit(top)).alias("h"))
    for _ in range(max_rounds):
        start = state = persisted(state)
        for _ in range(every):
            d = around8(state)
            low = F.least(*(F.col(f"n{k}") for k in range(8)))  # nulls beyond the edge are skipped
            state = d.withColumn("h", F.when(at_edge, F.col("h")).otherwise(F.least(F.col("h"), F.greatest(F.col("ground"), low)))).select("i", "j", "ground", "h")
        state = persisted(state)
        if start.select("i", "j", F.col("h").alias("was")).join(state, ["i", "j"]).where("was <> h").isEmpty():
            return df.drop("h").join(state.select("i", "j", "h"), ["i", "j"])
    raise RuntimeError("depressions did not settle")


def strahler(df: DataFrame, area: str, threshold: float, max_rounds: int = 10_000) -> DataFrame:
    """order of channel cells (area at least threshold), 0 elsewhere: the largest of the donors', one more if two share it.

    Cells are settled downstream from the sources, all whose donors are settled at once.
    """
    net = persisted(receivers(df).where(F.col(area) >= threshold).select("i", "j", "ri", "rj"))
    degree = net.where("ri is not null").groupBy(F.col("ri").alias("i"), F.col("rj").alias("j")).agg(F.count(F.lit(1)).alias("due"))
    todo = persisted(net.join(degree, ["i", "j"], "left").select("i", "j", "ri", "rj", F.coalesce("due", F.lit(0)).alias("due"), F.lit(0).alias("got"), F.lit(0).alias("top"), F.lit(0).alias("ties")))
    done = None
    for _ in range(max_rounds):
        ready = todo.where("got = due").select("i", "j", "ri", "rj", F.when(F.col("due") == 0, 1).otherwise(F.col("top") + (F.col("ties") > 1).cast("int")).alias("order"))
        settled = persisted(ready)
        if settled.isEmpty():
            break
        done = settled.select("i", "j", "order") if done is None else done.union(settled.select("i", "j", "order"))
        new = settled.where("ri is not null").groupBy(F.col("ri").alias("i"), F.col("rj").alias("j"), "order").agg(F.count(F.lit(1)).alias("n"))
        new = new.groupBy("i", "j").agg(F.sum("n").alias("n_got"), F.max(F.struct("order", "n")).alias("best"))
        left = todo.where("got < due").join(new, ["i", "j"], "left")
        more, tie = F.col("best.order") > F.col("top"), F.col("best.order") == F.col("top")
        todo = persisted(left.select("i", "j", "ri", "rj", "due", (F.col("got") + F.coalesce("n_got", F.lit(0))).cast("int").alias("got"), F.when(more, F.col("best.order")).otherwise(F.col("top")).alias("top"), F.when(more, F.col("best.n")).when(tie, F.col("ties") + F.col("best.n")).otherwise(F.col("ties")).cast("int").alias("ties")))
    out = df if done is None else df.join(done, ["i", "j"], "left")
    return out.withColumn("order", F.coalesce("order", F.lit(0)) if done is not None else F.lit(0))


def ridges(df: DataFrame) -> DataFrame:
    """ridge: 1 where a cell is higher than all its neighbours."""
    d = around8(df)
    top = F.greatest(*(F.col(f"n{k}") for k in range(8)))
    return d.withColumn("ridge", (F.col("h") > top).cast("double")).select(*df.columns, "ridge")


def seed_distance(df: DataFrame, m: Metrics, seed: str) -> DataFrame:
    """distance to the nearest cell whose seed exceeds 0.5, over the grid's diagonal; 1 without seeds.

    Jump flooding: rounds at halving steps, each comparing nine cells through
    lines windows (lag and lead by the step), so no cell is paired with all seeds.
    """
    own = F.when(F.col(seed) > 0.5, F.struct(F.col("i").alias("x"), F.col("j").alias("y")))
    state = df.withColumn("__near", own)
    step = (1 << max(0, max(m.width, m.height) - 1).bit_length()) // 2
    while step >= 1:
        d = state.withColumns({"__s": F.lead("__near", step).over(along_j()), "__n": F.lag("__near", step).over(along_j())})
        names, lines = ["__near"], {}
        for k, (column, dj) in enumerate((("__n", -1), ("__near", 0), ("__s", 1))):
            for di in (-1, 0, 1):
                if (di, dj) == (0, 0):
                    continue
                name = f"__c{k}{di + 1}"
                lines[name] = F.col(column) if di == 0 else F.lead(column, step).over(along_i()) if di > 0 else F.lag(column, step).over(along_i())
                names.append(name)
        d = d.withColumns(lines)
        # reading order decides among equal distances
        far = F.lit(1 << 40)
        ranked = F.array_min(F.array(*(F.struct(F.coalesce(_squared(n), far).alias("d"), F.lit(r).alias("r"), F.col(n).alias("p")) for r, n in enumerate(names))))
        state = d.withColumn("__near", ranked["p"]).select(*df.columns, "__near")
        step //= 2
    diagonal = math.hypot(m.width, m.height)
    return state.withColumn("distance", F.coalesce(F.least(F.sqrt(_squared("__near").cast("double")) / diagonal, F.lit(1.0)), F.lit(1.0))).drop("__near")


def _squared(point: str) -> Column:
    dx, dy = F.col("i") - F.col(f"{point}.x"), F.col("j") - F.col(f"{point}.y")
    return (dx * dx + dy * dy).cast("long")


def multi_flow(df: DataFrame, m: Metrics, passes: int) -> DataFrame:
    """flow: rain of 1 that each cell hands to all lower neighbours by drop, passes times."""
    d = around8(df)
    drop = {f"__w{k}": F.coalesce(F.greatest(F.col("h") - F.col(f"n{k}"), F.lit(0.0)) / (math.sqrt(2.0) if di and dj else 1.0), F.lit(0.0)) for k, (di, dj) in enumerate(D8)}
    d = d.withColumns(drop)
    total = sum(F.col(f"__w{k}") for k in range(8))
    shares = d.withColumn("__t", total).select(*df.columns, *(F.when(F.col("__t") > 1e-8, F.col(f"__w{k}") / F.col("__t")).otherwise(0.0).alias(f"s{k}") for k in range(8)))
    state = persisted(shares.withColumn("flow", F.lit(1.0)))
    for n in range(max(1, passes)):
        out = state
        for k in range(8):
            out = out.withColumn(f"__o{k}", F.col("flow") * F.col(f"s{k}"))
        # what a cell gets from a neighbour is what that sends in the opposite direction
        by_line = {f"__v{k}": F.col(f"__o{k}") if dj == 0 else F.lag(f"__o{k}").over(along_j()) if dj > 0 else F.lead(f"__o{k}").over(along_j()) for k, (_, dj) in enumerate(D8)}
        out = out.withColumns(by_line)
        got = {f"__g{k}": F.col(f"__v{k}") if di == 0 else F.lag(f"__v{k}").over(along_i()) if di > 0 else F.lead(f"__v{k}").over(along_i()) for k, (di, _) in enumerate(D8)}
        out = out.withColumns(got)
        out = out.withColumn("flow", 1.0 + sum(F.coalesce(F.col(f"__g{k}"), F.lit(0.0)) for k in range(8))).select(*state.columns)
        state = persisted(out) if n % 4 == 3 else out
    return state.select(*df.columns, "flow")


def thermal(df: DataFrame, m: Metrics, talus_deg: float, strength: float, iterations: int, soft: Column | float = 1.0) -> DataFrame:
    """An eighth of each excess over the repose angle moves to that neighbour, by strength and softness; mass is kept.

    A Jacobi step: what leaves and what arrives is read from one snapshot.
    """
    state = df
    for n in range(iterations):
        d = around8(state)
        excess = {f"__x{k}": F.greatest(F.coalesce(F.col("h") - F.col(f"n{k}") - math.tan(math.radians(talus_deg)) * math.hypot(di * m.dx, dj * m.dz), F.lit(0.0)), F.lit(0.0)) for k, (di, dj) in enumerate(D8)}
        d = d.withColumns(excess)
        share = 0.125 * min(max(strength, 0.0), 1.0) * clamp(soft if isinstance(soft, Column) else F.lit(float(soft)))
        d = d.withColumns({f"__o{k}": F.col(f"__x{k}") * share for k in range(8)})
        d = d.withColumns({f"__v{k}": F.col(f"__o{k}") if dj == 0 else F.lag(f"__o{k}").over(along_j()) if dj > 0 else F.lead(f"__o{k}").over(along_j()) for k, (_, dj) in enumerate(D8)})
        d = d.withColumns({f"__g{k}": F.col(f"__v{k}") if di == 0 else F.lag(f"__v{k}").over(along_i()) if di > 0 else F.lead(f"__v{k}").over(along_i()) for k, (di, _) in enumerate(D8)})
        moved = sum(F.coalesce(F.col(f"__g{k}"), F.lit(0.0)) for k in range(8)) - sum(F.col(f"__o{k}") for k in range(8))
        state = d.withColumn("h", F.col("h") + moved).select(*df.columns)
        state = persisted(state) if n % 4 == 3 else state
    return state


def smear(df: DataFrame, value: str, iterations: int, strength: float) -> DataFrame:
    """Iterated largest of the 4-neighbourhood, by strength."""
    s = min(max(strength, 0.0), 1.0)
    for _ in range(max(1, iterations)):
        d = near4(df, value)
        top = F.greatest(value, "left", "right", "down", "up")
        df = d.withColumn(value, clamp(F.col(value) * (1.0 - s) + top * s)).drop("left", "right", "down", "up")
    return df


def drainage_density(df: DataFrame, channel: str, radius: int) -> DataFrame:
    """density: mean of a channel mask over the part of a square inside the grid."""
    from .stencil import shrinking_mean

    return shrinking_mean(df.withColumn("density", F.col(channel)), radius, 1, "density")


def stream_order_log2(area: Column, threshold: float) -> Column:
    return F.when(area >= threshold, 1 + F.floor(F.log2(area / threshold))).otherwise(0).cast("int")


def channel_width(area: Column, threshold: float, scale: float) -> Column:
    return F.when(area >= threshold, scale * F.sqrt(area / threshold)).otherwise(0.0)




def standing_water(df: DataFrame, spawn: float, viscosity: float, iterations: int, strength: float) -> DataFrame:
    """h raised by strength times the water that stands after levelling, and wet, its share of what was spawned.

    Each round reads one snapshot. A cell hands water to lower neighbours, and
    keeps what is left and what comes from its right and lower neighbours: what
    left and upper ones hand it is lost, which is how the levelling is defined.
    """
    v = min(max(viscosity, 0.05), 0.95)
    d = df.withColumn("__w", F.lit(float(spawn)))
    for n in range(max(1, iterations)):
        d = d.withColumn("__s", F.col("h") + F.col("__w"))
        s = F.col("__s")
        ways = {"l": F.lag(s).over(along_i()), "r": F.lead(s).over(along_i())}
        d = d.withColumns({"__u": F.lag(s).over(along_j()), "__d": F.lead(s).over(along_j())})
        d = d.withColumns({f"__{k}": w for k, w in ways.items()})
        d = d.withColumns({f"__f{k}": F.when(F.col(f"__{k}") < s, (s - F.col(f"__{k}")) * (1.0 - v) * 0.2).otherwise(0.0) for k in "lrud"})
        total = F.col("__fl") + F.col("__fr") + F.col("__fu") + F.col("__fd")
        d = d.withColumn("__k", F.when((total > F.col("__w")) & (total > 1e-6), F.col("__w") / total).otherwise(1.0))
        d = d.withColumns({f"__f{k}": F.col(f"__f{k}") * F.col("__k") for k in "lrud"})
        back = {"__a": F.coalesce(F.lead("__fu").over(along_j()), F.lit(0.0))}
        d = d.withColumns(back).withColumn("__b", F.coalesce(F.lead("__fl").over(along_i()), F.lit(0.0)))
        kept = F.greatest(F.col("__w") - (F.col("__fl") + F.col("__fr") + F.col("__fu") + F.col("__fd")), F.lit(0.0))
        d = d.withColumn("__w", kept + F.col("__a") + F.col("__b")).select(*df.columns, "__w")
        d = persisted(d) if n % 4 == 3 else d
    wet = F.col("__w") > 1e-4
    return d.select(*(c for c in df.columns if c != "h"), F.when(wet, F.col("h") + F.col("__w") * strength).otherwise(F.col("h")).alias("h"), F.when(wet, clamp(F.col("__w") / max(spawn, 1e-3))).otherwise(0.0).alias("wet"))
