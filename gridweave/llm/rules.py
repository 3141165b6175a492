"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio against the raw corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, labels, materialize, whole
from .text import Words, mix, runs, slices

#: Byte n-grams are counted in 2**BITS buckets.
GRAM, BITS = 4, 16
#: N-grams that the raw corpus adds to the target's counts, so that an unseen bucket shrinks to a ratio of 1.
PRIOR = 200_000.0
#: Labels have 10 bytes a row; more than this many are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Scores are counted in buckets of this width for the threshold.
WIDTH = 1 / 4096
MIN_WORDS, MAX_REPEATED, RUN = 10, 20, 5

_GRAMS = np.random.default_rng(88).integers(0, 2**63, (GRAM, 256), dtype=np.uint64)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the byte n-gram at each byte but the last GRAM - 1."""
    n = max(0, len(data) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h ^= _GRAMS[i][data[i : n + i]]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


def _ranges(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's own n-grams, as ranges of buckets()."""
    a = np.minimum(offsets[:-1], n)
    return a, np.clip(offsets[1:] - (GRAM - 1), a, n)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    b = buckets(data)
    inside = np.ones(len(b), bool)
    for k in range(1, GRAM):  # n-grams that run into the next text
        at = offsets[1:-1] - k
        inside[at[(at >= 0) & (at < len(b))]] = False
    return np.bincount(b[inside], minlength=1 << BITS)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of _BASE for a slice of texts."""
    words = Words(data, offsets)
    counts, n = words.counts, len(words.starts)
    # code points of words: bytes that are not continuation bytes
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = _per_text(lead[words.ends] - lead[words.starts], words.first)
    symbols = _per_text(_SYMBOL[data], offsets)
    doc = words.doc_of()
    hashes = words.hashes()

    # windows of RUN words met twice or more in their text
    grams = runs(hashes, RUN)
    inside = doc[: len(grams)] == doc[RUN - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = mix(grams[at] + mix(doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    step[at[twice]] += 1
    step[at[twice] + RUN] -= 1
    repeated = _per_text(np.cumsum(step[:-1]) > 0, words.first)

    # lines with a word, equal to an earlier line of their text: hashed as whole byte ranges
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    edge = np.unique(np.concatenate([offsets[1:], breaks]))
    ends = np.where(data[starts] == 10, starts, edge[np.searchsorted(edge, starts, "right")]) if len(starts) else starts
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    line_doc = np.searchsorted(offsets, starts, "right") - 1
    seen: dict[tuple, int] = {}
    dup = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    # only lines whose length recurs in their text can be equal
    length_key = line_doc * (int((ends - starts).max(initial=0)) + 1) + (ends - starts)
    _, back, times = np.unique(length_key, return_inverse=True, return_counts=True)
    last = -1
    for i in np.flatnonzero(times[back] > 1).tolist():
        d = int(line_doc[i])
        if d != last:
            seen, last = {}, d
        line = raw[starts[i] : ends[i]]
        if line in seen:
            dup[d] += 1
        else:
            seen[line] = 1
    return [counts.astype(np.int64), chars, symbols, dup, repeated]


@dataclass
class Target:
    """Log ratio of the trusted target's to the raw corpus's multinomial for each bucket, and the least mean kept."""

    ratio: np.ndarray
    threshold: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log-likelihood ratio for each n-gram; 0 for texts shorter than one."""
        b = buckets(data)
        total = np.zeros(len(b) + 1)
        np.cumsum(self.ratio[b], out=total[1:])
        lo, hi = _ranges(offsets, len(b))
        return (total[hi] - total[lo]) / np.maximum(1, hi - lo)


def _corpus_counts(texts: DataFrame) -> np.ndarray:
    """Bucket counts over every whole text of the column text: tasks add up, then buckets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                total += gram_counts(data, offsets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select(whole("text").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _score_counts(rows: DataFrame, target: Target) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Buckets' middles and counts of the scores of (text, good) rows: those of quality 0, then the trusted."""
    on_tasks = rows.sparkSession.sparkContext.broadcast(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, data, offsets in slices(b.column(0)):
                at = np.floor(on_tasks.value.score(data, offsets) / WIDTH).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(a, e - a), pa.array(at)], names=["good", "at"])

    found = rows.select(whole("text").alias("text"), "good").mapInArrow(run, "good boolean, at long").groupBy("good", "at").agg(F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    sides = [[r for r in found if r.good == good] for good in (False, True)]
    return [np.array([(r["at"] + 0.5) * WIDTH for r in side]) for side in sides], [np.array([r.n for r in side], np.int64) for side in sides]


def _quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """np.quantile of ascending values, each as often as it counts."""
    upto = np.cumsum(counts)
    at = q * (upto[-1] - 1)
    lo, hi = (values[np.searchsorted(upto, i, "right")] for i in (np.floor(at), np.ceil(at)))
    return float(lo + (hi - lo) * (at - np.floor(at)))


def train(docs: DataFrame, rated: DataFrame) -> Target:
    """The raw multinomial counts all of docs, the target and the threshold all rated rows (doc_id, quality).

    One half of the rated rows, those of quality 1, gives the target, the other,
    unseen by it, the threshold: half way between what nearly all trusted texts
    exceed and what nearly all texts of quality 0 fall short of, if these are
    apart, else at the first. Only counts by bucket, of n-grams and of scores,
    come to the driver. Without trusted rows every document is kept.
    """
    sample = rated.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).alias("good")).where("good is not null and doc_id is not null")
    src = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    sample = sample.withColumn("fits", F.pmod(F.xxhash64(F.lit("target"), "doc_id"), F.lit(2)) == 0)
    few = sample.count() <= BROADCAST_LABELS
    own = src.join(F.broadcast(sample) if few else sample, src["d"] == sample["doc_id"]).select("text", "good", "fits")
    own = own if few else materialize(own)  # the shuffle is of whole texts
    good = _corpus_counts(own.where("good and fits"))
    if not good.sum():
        return Target(np.zeros(1 << BITS), -np.inf)
    raw = _corpus_counts(docs)
    share = np.maximum(raw, 0.5) / max(raw.sum(), 1.0)
    target = Target(np.log((good + PRIOR * share) / (good.sum() + PRIOR) / share), -np.inf)

    (bad_at, good_at), (bad_n, good_n) = _score_counts(own.where("not fits"), target)
    if not len(good_n):
        return target
    low = _quantile(good_at, good_n, 0.002)
    if len(bad_n):
        high = _quantile(bad_at, bad_n, 0.95)
        target.threshold = (low + high) / 2 if high < low else low
    else:
        target.threshold = low - (_quantile(good_at, good_n, 0.5) - low)
    return target


def judge(docs: DataFrame, target: Target, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> DataFrame:
    """doc_id, the counts of _BASE, score, base_failed and kept of every row.

    A text fails the base rules with fewer than min_words words, or if over
    max_repeated percent of its words are in runs of RUN words found twice or
    more in it. Otherwise its mean log-likelihood ratio decides; every document
    meets the same threshold. One pass, no shuffle, whole texts.

    Null text has no words and fails. Other columns of docs are ignored; each row
    gives a row.
    """
    on_tasks = docs.sparkSession.sparkContext.broadcast(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = on_tasks.value
        for b in batches:
            for a, e, data, offsets in slices(b.column(1)):
                base = base_counts(data, offsets)
                score = target.score(data, offsets)
                failed = (base[0] < min_words) | (100 * base[4] > max_repeated * base[0])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), *map(pa.array, base), pa.array(score), pa.array(failed), pa.array(~failed & (score >= target.threshold))], names=["doc_id", *_BASE, "score", "base_failed", "kept"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _BASE) + ", score double, base_failed boolean, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return judge(docs, train(docs, labels(spark, sf_dir)))
