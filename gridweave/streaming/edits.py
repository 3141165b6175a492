"""Edit streams: bursts coalesced by session windows, and the newest generation of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounced(edits: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", lateness: str | None = None) -> DataFrame:
    """One row for each burst of a key's edits, closed by a gap without any; works on batches and streams."""
    e = edits.withWatermark(ts, lateness) if lateness else edits
    return e.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("edits")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "edits")


def latest(edits: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest edit of each key; a maximum, so it combines on the map side."""
    rest = [c for c in edits.columns if c != key and c not in order]
    return edits.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("e")).select(key, "e.*")


def budgeted(requests: DataFrame, budget: int, cost: str, *order, least: int = 1) -> DataFrame:
    """Requests in order as long as their running cost stays within budget.

    A request costs at least ``least``, so that budget / least requests can be
    served at most; only so many are ordered, which each task first cuts down to.
    """
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = requests.orderBy(*order).limit(-(-budget // least))
    return first.withColumn("spent", F.sum(cost).over(w)).where(F.col("spent") <= budget)


def latest_sink(stream: DataFrame, path: str, key: str, *order: str):
    """Starts a stream that keeps the newest edit of each key in each micro-batch as Parquet."""

    def put(batch: DataFrame, epoch: int) -> None:
        latest(batch, key, *order).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(put)
