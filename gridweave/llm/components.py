"""Connected components of a link table, wholly as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links to (node, root), root the smallest node reachable; one row for each node with a link.

    Alternates large-star and small-star: every node hands its larger, then its
    smaller, neighbours to its smallest one. Neighbourhoods are only ever reduced
    to a minimum (combined on the map side), never collected, so that a hub is no
    hot group; each round's links are written to the shared folder, and the loop
    ends when a round changes no link. Self-links and repeated links are harmless.
    """

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = materialize(oriented(links))
    seen = mark(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = oriented(large)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, large["u"] == least["c"])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        now = materialize(oriented(small))
        if (after := mark(now)) == seen:
            break
        seen = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
