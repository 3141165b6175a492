"""SimHash near-duplicates with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import documents, drop_rows, materialize, text_key, whole
from .components import components
from .text import mix

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Blocks of the fingerprint and how many of them a bucket fixes: RADIUS differences leave BLOCKS - RADIUS blocks alike.
BLOCKS, FIXED = 6, 2
#: Rows that a task fingerprints and hands back at once.
OUT_ROWS = 500
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 24, dtype=np.uint64)
#: Rows of a bucket, at most, that are compared at each depth; a larger bucket is split by further blocks. At the last depth 45
#: bits are fixed, so that no bucket has more than 2**19 rows.
MOST = (4096, 65_536, 1 << 19)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the shingles' XXH64 values; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < shingle:
        hashes = np.array([xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
        starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
        hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for part in np.array_split(hashes, len(hashes) // 1_000_000 + 1):
        ones += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id and fp (signed 64 bits) of every whole text; null text counts as empty. keyed: also own, the row's text_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(lo, OUT_ROWS) for part in batches for lo in range(0, part.num_rows, OUT_ROWS)):
            fps = np.fromiter((fingerprint(t or b"") for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["doc_id", "fp", *b.schema.names[2:]])

    more = [text_key().alias("own")] if keyed else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").cast("binary").alias("text"), *more).mapInArrow(run, "doc_id long, fp long" + ", own string" * keyed)


def _masks(bits: list[int], blocks: int = BLOCKS, fixed: int = FIXED) -> list[int]:
    """Masks of every choice of fixed blocks among the given bits."""
    edges = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(blocks)]
    return [sum(c) for c in combinations(parts, fixed)]


@cache
def _choices(path: int) -> list[int]:
    """Bits fixed after each further choice: path has the choices so far as hexadecimal digits after a 1."""
    taken, digits = 0, hex(path)[3:]
    for digit in digits:
        taken |= _masks([b for b in range(64) if not taken >> b & 1])[int(digit, 16)]
    return [taken | m for m in _masks([b for b in range(64) if not taken >> b & 1])]


def _split(rows: DataFrame) -> DataFrame:
    """(fp, path) to a row (fp, path, key) for each further choice; the fixed bits and the path name a bucket, key is their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(lo, 4096) for part in batches for lo in range(0, part.num_rows, 4096)):
            fp, path = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for p in np.unique(path).tolist():
                own = fp[path == p]
                for i, m in enumerate(_choices(p)):
                    key = mix(mix(own & np.uint64(m)) + np.uint64(16 * p + i))
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.full(len(own), 16 * p + i)), pa.array(key.view(np.int64))], names=["fp", "path", "key"])

    return rows.select("fp", "path").mapInArrow(run, "fp long, path long, key long")


def local_links(bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets (consecutive equal values of bucket), as (fp, root): a spanning star for each linked set.

    The pivot table holds each fingerprint's Hamming distances to PIVOTS. Rows
    of a bucket are sorted by the first coordinate; a pair is met while that
    differs by RADIUS at most, goes on while every further coordinate does, and
    survivors are verified. Two fingerprints already in one set are not met again.
    """
    first = np.bitwise_count(fp ^ PIVOTS[0]).astype(np.int16)
    order = np.lexsort((first, bucket))
    bucket, fp, first = bucket[order], fp[order], first[order]
    root = np.arange(len(fp))
    table: dict[int, np.ndarray] = {}
    at = np.arange(len(fp) - 1)
    step = 1
    while len(at := at[at + step < len(fp)]) and len(at := at[(bucket[at] == bucket[at + step]) & (first[at + step] - first[at] <= RADIUS)]):
        i = at[root[at] != root[at + step]]
        for k in range(1, len(PIVOTS)):
            if not len(i):
                break
            if k not in table:
                table[k] = np.bitwise_count(fp ^ PIVOTS[k]).astype(np.int16)
            i = i[np.abs(table[k][i] - table[k][i + step]) <= RADIUS]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= RADIUS]
        while len(i):  # hook the larger root under the smaller, then shorten the paths
            a, b = root[i], root[i + step]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root != (nxt := root[root])).any():
                root = nxt
            i = i[root[i] != root[i + step]]
        step += 1
    linked = np.flatnonzero(root != np.arange(len(root)))
    return fp[linked], fp[root[linked]]


def links(fps: DataFrame) -> DataFrame:
    """(u, v) over distinct fingerprints; their components are those of all links at RADIUS bits or fewer.

    No key but equality can enumerate candidates, so distinct fingerprints meet
    in buckets that fix FIXED of BLOCKS blocks: RADIUS differences spoil at most
    RADIUS blocks, so linked fingerprints share a bucket. Within buckets the
    pivot table discards pairs. Buckets of more than MOST rows, a number that
    does not grow with the data, are split by a second and third choice of blocks
    among the bits left free, which loses no link either; no bucket's pairs are
    ever emitted. The counts of buckets are written and joined back: those of one
    fingerprint, nearly all, never reach Python.
    """
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = F.array(*(F.struct(F.lit(16 + i).cast("long").alias("path"), F.lit(signed(m)).alias("m")) for i, m in enumerate(_choices(1))))
    rows = fps.select("fp", F.explode(masks).alias("c")).select("fp", "c.path", F.xxhash64("c.path", F.col("fp").bitwiseAND(F.col("c.m"))).alias("key"))
    ready = []
    for depth, most in enumerate(MOST):
        counts = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        rows = rows.join(counts, "key")
        last = depth + 1 == len(MOST) or counts.where(F.col("n") > most).isEmpty()
        ready.append((rows if last else rows.where(F.col("n") <= most)).select("key", "fp"))
        if last:
            break
        rows = materialize(_split(rows.where(F.col("n") > most)))
    rows = reduce(DataFrame.union, ready)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(key, fp):
            u, v = local_links(key, fp)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            key = np.concatenate([rest_key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut = np.searchsorted(key, key[-1]) if len(key) else 0
            rest_key, rest_fp = key[cut:], fp[cut:]
            if cut:
                yield out(key[:cut], fp[:cut])
        if len(rest_key):
            yield out(rest_key, rest_fp)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Copies share a fingerprint and meet as one row with their smallest doc_id;
    the links of distinct fingerprints go through components(), and only slim
    tables are joined back. Null and empty texts, and texts without words, have
    fingerprint 0, linked like any other. Rows with a null doc_id get the
    component's id and never give it (null if nothing else is in it). Repeated
    rows each get a row; other columns of docs are ignored.
    """
    own = materialize(fingerprints(docs))
    classes = _classes(own)
    return own.join(classes, own["fp"] == classes["c_fp"]).select("doc_id", "fp", "component_id")


def _classes(own: DataFrame) -> DataFrame:
    """(c_fp, root, component_id) of each distinct fingerprint; root tells components without, or with one, component_id apart."""
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(fps))
    fps = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = fps.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r")
    return fps.join(ids, fps["root"] == ids["r"]).select(F.col("fp").alias("c_fp"), "root", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: that with the smallest doc_id (null last), then the least text_key; one of equal rows."""
    own = materialize(fingerprints(docs, keyed=True))
    classes = _classes(own)
    rows = own.join(classes, own["fp"] == classes["c_fp"]).select("doc_id", "own", "root")
    best = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), "own")).alias("best")).where("n > 1").select(F.col("root").alias("b_root"), "best")
    rows = rows.join(best, rows["root"] == best["b_root"])
    return drop_rows(docs, rows.select("doc_id", "own", (F.col("doc_id").eqNullSafe(F.col("best.i")) & (F.col("own") == F.col("best.own"))).alias("stays")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
