"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import persisted as materialize

__all__ = ["SPACE", "WORD", "documents", "drop_rows", "fresh", "labels", "materialize", "numbered", "restored", "text_key", "whole"]

#: Java regular expressions for white space and words; the same characters as in ``text._WS``.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole(text: str | Column) -> Column:
    """The text, or the empty text where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str | Column = "text") -> Column:
    """What tells rows of one doc_id apart: a digest of the text as it is."""
    return F.sha2(whole(text), 256)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, ..., and the new name of each column.

    Whatever a caller's columns are called (dots, reserved words, an operator's own
    names), they then clash with nothing; restored() gives the names back.
    """
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), {name: f"c{k}" for k, name in enumerate(docs.columns)}


def restored(names: dict[str, str]) -> list[Column]:
    return [F.col(new).alias(old) for old, new in names.items()]


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many further underscores as make it none of docs' columns."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


#: Bits of the sketch of classes that go: 2**20 cells of 64 bits, 16 MB at most whatever the input.
CELL_BITS = 20


def drop_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs, with all its columns, less the rows that go.

    rows has (doc_id, own, stays) for each row of docs in a group of several, own
    being its text_key. Rows with the same doc_id, null or not, and the same own
    are equal: they share a verdict, and one of them stays (the least by its
    other columns). Texts of rows that stay for sure do not move: a bit map of
    fixed size says which rows may be in a class that goes, and only those, the
    copies and a few false alarms, are shuffled to the classes. A full map costs
    shuffle, never a wrong row.
    """
    classes = rows.groupBy("doc_id", "own").agg(F.max("stays").alias("once"), F.count(F.lit(1)).alias("n")).where("not once or n > 1")
    classes = materialize(classes.select(F.col("doc_id").alias("k_id"), F.col("own").alias("k_own"), "once"))
    again = classes.where("once")
    bit = lambda h: F.expr(f"shiftleft(1L, cast({h} & 63 as int))")
    cell = F.shiftrightunsigned("h", 64 - CELL_BITS).alias("cell")
    sketch = classes.select(F.xxhash64("k_id", "k_own").alias("h")).select(cell, bit("h").alias("b")).groupBy("cell").agg(F.bit_or("b").alias("bits"))
    d, names = numbered(docs)
    key = text_key(names["text"])
    marked = d.withColumn("h", F.xxhash64(names["doc_id"], key)).withColumn("cell", cell).join(F.broadcast(sketch), "cell", "left")  # 2**CELL_BITS rows at most
    may = F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(bit("h")) != 0
    same = F.col(names["doc_id"]).eqNullSafe(F.col("k_id")) & (key == F.col("k_own"))
    suspects = marked.where(may).select(*names.values())
    stay = marked.where(~may).select(*names.values()).unionByName(suspects.join(classes.hint("merge"), same, "left_anti"))
    if not again.isEmpty():
        one = suspects.join(again.hint("merge"), same).groupBy("k_id", "k_own").agg(F.min(F.struct(*names.values())).alias("row"))
        stay = stay.unionByName(one.select("row.*"))
    return stay.select(*restored(names))
