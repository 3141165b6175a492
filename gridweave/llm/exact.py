"""Exact deduplication by content-defined chunk recipes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, documents, drop_rows, materialize, text_key, whole

#: A chunk runs from MIN_CHUNK code points to the next punctuation mark, or to MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 256, 2048
_CHUNK = rf"(?s).{{{MIN_CHUNK}}}.{{0,{MAX_CHUNK - MIN_CHUNK}}}?[\p{{Punct}}、。！，？]|(?s).{{1,{MAX_CHUNK}}}"
_SECOND = "gridweave-chunk"


def _ids(chunk: Column) -> Column:
    """128 bits of a chunk, from two seeds."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(_SECOND), chunk).alias("b"))


def _grouped(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each row's doc_id, n_cp, text_sha256 and columns, and of a group of several n and its best row; see exact_groups."""
    names, more = list(columns), [c.alias(k) for k, c in columns.items()]
    base = docs.select(F.col("doc_id"), whole("text").alias("text")).select("doc_id", *more, F.char_length("text").cast("long").alias("n_cp"), F.regexp_replace("text", SPACE + "+", "").alias("norm"))
    chunked = base.withColumn("chunks", F.regexp_extract_all("norm", F.lit(_CHUNK), F.lit(0)))
    slim = materialize(chunked.select("doc_id", *names, "n_cp", F.sha2("norm", 256).alias("text_sha256"), F.transform("chunks", _ids).alias("recipe")))

    # the store holds a digest of each chunk, which is as long for any chunk; under two digests an identifier is not verified
    store = chunked.select(F.explode("chunks").alias("c")).select(_ids(F.col("c")).alias("id"), F.sha2("c", 256).alias("s")).groupBy("id.a", "id.b").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    unverified = materialize(store.where("lo <> hi").select("a", "b"))  # two in 2**64 chunks share an identifier by chance
    if unverified.isEmpty():
        slim = slim.withColumn("digest", F.lit(""))
    else:
        held = slim.select("text_sha256", F.explode("recipe").alias("id")).select("text_sha256", "id.a", "id.b").distinct()
        held = held.join(unverified, ["a", "b"], "left_semi").select(F.col("text_sha256").alias("u_sha256")).distinct()
        slim = slim.join(held, slim["text_sha256"] == held["u_sha256"], "left").withColumn("digest", F.when(F.col("u_sha256").isNotNull(), F.col("text_sha256")).otherwise("")).drop("u_sha256")
    key = ["digest", "recipe"]
    groups = slim.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("n_cp")).alias("m"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), *names)).alias("best"))
    groups = groups.where("n > 1").select(*(F.col(k).alias(f"g_{k}") for k in key), "n", "best")
    return slim.join(groups, [slim[k] == groups[f"g_{k}"] for k in key], "left")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Groups of documents whose texts are equal after white space is deleted.

    1. Each text becomes a recipe: the ordered identifiers of its content-defined
       chunks. Equal texts have equal recipes, so a text moves no further.
    2. Every chunk goes once, combined on the map side, to the chunk store as its
       identifier and SHA-256, which stands for its bytes. An identifier under
       which two chunks differ is not verified; recipes that hold one are compared
       by the digest of the whole text.
    3. Recipes, not texts, are grouped. Only groups of two or more are joined
       back, so that a hot group is combined before its shuffle, and the
       join's hot side is slim rows that adaptive execution can split.

    Of a group the row with the most code points in its original text stays,
    then the one with the smallest doc_id (null last). Returns one row for each
    row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts form a group. Rows repeated
    with the same doc_id and text count in group_size and are kept or dropped
    together. Other columns of docs are ignored. No rows give no rows.
    """
    joined = _grouped(docs)
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.i"))
    stays = F.col("n").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.i")) & (-F.col("n_cp") == F.col("best.m")))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), stays.alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: exactly one of each group, null doc_ids included.

    It is the row that exact_groups marks; where that marks several, the one with
    the least text_key, and one of equal rows.
    """
    joined = _grouped(docs, own=text_key()).where("n is not null")
    return drop_rows(docs, joined.select("doc_id", "own", (F.col("doc_id").eqNullSafe(F.col("best.i")) & (F.col("own") == F.col("best.own"))).alias("stays")))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
