"""The grids that the catalogued queries run on, and the SQL for the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.grid import Metrics, complete

#: All of lineitem as a 32 by 32 grid of 10 m cells, in tiles of 8 cells.
M = Metrics(32, 32, 320.0, 320.0, tile=8)

GRID = """
g0 AS (SELECT CAST(l_orderkey % 32 AS INT) AS i, CAST(l_partkey % 32 AS INT) AS j, avg(l_extendedprice) AS h FROM lineitem GROUP BY 1, 2),
c AS (SELECT CAST(a.range AS INT) AS i, CAST(b.range AS INT) AS j FROM range(32) a, range(32) b),
g AS (SELECT c.i, c.j, round(coalesce(g0.h, 0.0) / 1000, 3) AS h FROM c LEFT JOIN g0 ON g0.i = c.i AND g0.j = c.j)"""

#: A second layer and a mask over the same cells.
LAYER = """
y0 AS (SELECT CAST(l_suppkey % 32 AS INT) AS i, CAST(l_linenumber * 5 % 32 AS INT) AS j, avg(l_quantity) AS h FROM lineitem GROUP BY 1, 2),
y AS (SELECT c.i, c.j, round(coalesce(y0.h, 0.0), 3) AS h FROM c LEFT JOIN y0 ON y0.i = c.i AND y0.j = c.j),
k AS (SELECT i, j, ((i * 7 + j * 13) % 11) / 10.0::DOUBLE AS w FROM c)"""


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lineitem(spark, sf_dir).groupBy((F.col("l_orderkey") % 32).cast("int").alias("i"), (F.col("l_partkey") % 32).cast("int").alias("j")).agg(F.avg("l_extendedprice").alias("h"))
    return complete(t, M).select("i", "j", F.round(F.col("h") / 1000, 3).alias("h"))


def layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lineitem(spark, sf_dir).groupBy((F.col("l_suppkey") % 32).cast("int").alias("i"), (F.col("l_linenumber") * 5 % 32).cast("int").alias("j")).agg(F.avg("l_quantity").alias("h"))
    return complete(t, M).select("i", "j", F.round("h", 3).alias("h"))


def mask(df: DataFrame) -> DataFrame:
    return df.select("i", "j", (((F.col("i") * 7 + F.col("j") * 13) % 11) / 10.0).alias("w"))


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that engines whose last bits differ give equal values."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in names})


def sql_rounded(query: str, exact: str, *columns: str, digits: int = 9) -> str:
    """A query's exact columns as they are and the others rounded."""
    parts = [*filter(None, [exact]), *(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)]
    return f"SELECT {', '.join(parts)} FROM ({query}) q"


def with_grid(body: str, more: str = "") -> str:
    return f"WITH {GRID}{more and ',' + more}\n{body}"


