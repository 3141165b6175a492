"""Mixing sources to target weights by capped water-filling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, fresh, materialize, numbered, restored, whole

WEIGHTS, BUDGET, EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2, "gridweave"
#: Buckets of the sampling order; a source's cut falls into one of them.
BUCKETS = 4096
#: The table of sources has under 100 bytes a row; beyond this many it is joined by a salted shuffle, and its running sums go by ranges.
BROADCAST_SOURCES, SALTS = 50_000, 64


def words_in(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def _place(doc_id: str, text: str, seed: str) -> Column:
    """60 seeded bits that order the documents of a source; the text stands in for a doc_id that is null."""
    own = F.coalesce(F.col(doc_id).cast("string"), F.md5(whole(text)))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), own)), 1, 15), 16, 10).cast("long")


def _ahead(df: DataFrame, by: list[Column], many: bool, **sums: Column) -> DataFrame:
    """df with, for each name, the sum of that column over the rows before in the order by, which has no ties.

    A table of many rows is sorted by ranges: tasks sum up their own, and the
    totals of tasks, one row each, are summed along.
    """
    names = list(sums)
    if not many:
        order = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(order), F.lit(0)) for n, c in sums.items()})
    df = materialize(df.withColumns(sums).repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    order = Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("range").agg(*(F.sum(n).alias(f"{n}_range") for n in names))
    along = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range", *(F.coalesce(F.sum(f"{n}_range").over(along), F.lit(0)).alias(f"{n}_range") for n in names))
    df = df.withColumns({n: F.coalesce(F.sum(n).over(order), F.lit(0)) for n in names}).join(F.broadcast(totals), "range")  # a row for each task
    return df.withColumns({n: F.col(n) + F.col(f"{n}_range") for n in names}).drop("range", *(f"{n}_range" for n in names))


def water_fill(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code point order, null last, take the weights in turn. Sorted by
    what they can hold for their weight, those that are clamped at epochs times
    their size come first, so running sums give every round of redistribution
    at once. sizes is a written table of one row for each source; the total, and
    the level of the sources that are not clamped, are numbers.
    """
    many = sizes.count() > BROADCAST_SOURCES
    name = F.col("source").asc_nulls_last()
    x = _ahead(sizes, [name], many, place=F.lit(1))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    x = x.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * epochs).withColumn("ratio", F.col("cap") / F.col("w"))
    total, weight = x.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    x = _ahead(x, [F.col("ratio").asc(), name], many, caps=F.col("cap"), ws=F.col("w"))
    x = x.withColumn("level", (F.lit(float(total) * budget) - F.col("caps")) / (F.lit(weight) - F.col("ws")))
    first = F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source"))
    level = x.where("level <= ratio").agg(first).first()[0]
    share = F.col("cap") if level is None else F.when(F.col("level") <= F.col("ratio"), F.least(F.col("cap"), F.lit(level) * F.col("w"))).otherwise(F.col("cap"))
    return x.select("source", "source_size", share.alias("target"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Joins each row to its source's plan without moving a hot source's rows to one task."""
    same = F.col("source").eqNullSafe(F.col("p_source"))
    if plan.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(plan), same)
    rows = rows.withColumn("salt", F.col("place") % SALTS)
    plan = plan.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(plan, same & (F.col("salt") == F.col("p_salt"))).drop("salt", "p_salt")


_ADDED = ("size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs with __size, __source_size, __target and __taken (words taken, repeats counted).

    A source's target, rounded to words, is so many whole repetitions of all its
    documents and a rest. The rest goes in a seeded order through whole documents
    and ends inside one, of which it takes the leading words; so each source is
    within one word of its target. The cut is found from word counts by bucket of
    that order, which are written once, and only the one bucket that holds it is
    sorted.

    Null text has size 0; null source is a source; documents of size 0 take 0
    words. Documents with null doc_id are ordered by their text. Rows with equal
    doc_id and size are interchangeable, so reruns agree; those that fall into
    the cut's bucket are sorted in one task. Where docs has a column of the name,
    a new one gets further underscores in front. No rows give no rows.
    """
    rows, names = _mixed(docs, weights, budget, epochs, seed)
    return rows.select(*restored(names), *(F.col(c).alias(n) for c, n in zip(_ADDED, fresh(docs, *(f"__{c}" for c in _ADDED)), strict=True)))


def _mixed(docs: DataFrame, weights: Sequence[float], budget: float, epochs: int, seed: str) -> tuple[DataFrame, dict[str, str]]:
    """mix() with docs' columns numbered, and their numbers."""
    d, names = numbered(docs)
    rows = d.withColumns({"source": F.col(names["source"]), "place": _place(names["doc_id"], names["text"], seed), "size": words_in(names["text"])})
    rows = rows.withColumn("bucket", F.shiftright("place", 60 - (BUCKETS - 1).bit_length()))
    hist = materialize(rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    sizes = materialize(hist.groupBy("source").agg(F.sum("n").alias("source_size")))
    hist = hist.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    whole_words = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    sources = water_fill(sizes, weights, budget, epochs).withColumn("full", full).withColumn("rest", whole_words - F.col("full") * F.col("source_size"))
    cuts = hist.alias("h").join(sources.alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).where("h.before <= s.rest")
    plan = materialize(cuts.groupBy(F.col("s.source").alias("p_source")).agg(F.max("h.bucket").alias("p_cut"), F.max("h.before").alias("p_before"), *(F.first(f"s.{c}").alias(f"p_{c}") for c in ("source_size", "target", "full", "rest"))))
    joined = _with_plan(rows, plan)
    start = F.when(F.col("bucket") < F.col("p_cut"), F.lit(0)).otherwise(F.col("p_rest"))
    outside = joined.where("bucket <> p_cut").withColumn("start", start.cast("long"))
    order = Window.partitionBy("source").orderBy("place", F.col(names["doc_id"]).asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = joined.where("bucket = p_cut").withColumn("start", F.col("p_before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("p_rest") - F.col("start")))
    part = F.when(F.col("bucket") < F.col("p_cut"), F.col("size")).otherwise(part)
    out = outside.unionByName(inside).withColumn("taken", (F.col("p_full") * F.col("size") + part).cast("long"))
    return out.withColumns({"source_size": F.col("p_source_size").cast("long"), "target": F.col("p_target")}), names


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs.

    The one document of a source in which its rest ends gives its leading words
    once more; documents of which nothing is taken, or that have no words, go.
    """
    m, names = _mixed(docs, weights, budget, epochs, seed)
    m = m.where("taken > 0").withColumn("rep", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = (F.col("taken") - (F.col("rep") - 1) * F.col("size")).cast("int")
    text = F.col(names["text"])
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), left), "")
    return m.withColumn(names["text"], F.when(left < F.col("size"), head).otherwise(text)).select(*restored(names))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('gridweave|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST(([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         CAST(source_size AS DOUBLE) * 2 AS cap FROM s
), r AS (
  SELECT *, cap / w AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total FROM w
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r
), t AS (
  SELECT source, source_size,
         CASE WHEN lev <= ratio THEN least(cap, w * first_value(CASE WHEN lev <= ratio THEN lev END IGNORE NULLS)
              OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) ELSE cap END AS target
  FROM l
), q AS (
  SELECT *, CAST(round(target) AS BIGINT) AS words,
         CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.whole, q.words - q.whole * q.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM c
"""
