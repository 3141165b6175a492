"""Ordinal cumulative-link quality classifier over hashed text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import documents, fresh, labels, numbered, restored, whole
from .text import Words, slices

WORD_BITS, GRAM_BITS, FORM_BITS = 15, 14, 10
#: Families of features: hashed words, hashed byte trigrams, forms of words (repeated, capital, ending, length), the text's length.
FIRST = np.cumsum([0, 1 << WORD_BITS, 1 << GRAM_BITS, 1 << FORM_BITS, 32])
SIZE = int(FIRST[-1])
SCALES = (3.0, 8.0, 8.0, 1.0)
#: Labelled rows that a model is fitted on, at most: those with the smallest hash of doc_id.
SAMPLE = 4000
ROUNDS, RATE, DECAY = 120, 0.08, 1e-3
#: A document is selected if its grade is at least GRADE with this probability.
GRADE, TAIL = 1, 0.5
#: Rows that a task scores and hands back at once.
OUT_ROWS = 1000

_GRAM = np.random.default_rng(33).integers(0, 2**32, (3, 256), dtype=np.uint64)


_ENDING = np.zeros(256, np.int64)  # letters and the rest, digits, sentence marks, symbols
_ENDING[48:58] = 1
_ENDING[list(b".,;:!?")] = 2
_ENDING[list(b"#*$%&|<>@^~=+")] = 3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each family the feature numbers of a slice's texts, and each text's first and end among them; the word counts."""
    words = Words(data, offsets)
    hashes, n = words.hashes(), words.counts
    by_word = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    k = max(0, len(data) - 2)
    h = _GRAM[0][data[:k]] ^ _GRAM[1][data[1 : k + 1]] ^ _GRAM[2][data[2:]]
    by_gram = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int32) + int(FIRST[1])
    lo = np.minimum(offsets[:-1], k)

    doc = words.doc_of()
    form = np.zeros(len(hashes), np.int64)
    for back in (1, 2):
        form[back:] += back * ((hashes[back:] == hashes[:-back]) & (doc[back:] == doc[:-back]))
    head, tail = data[words.starts], data[words.ends - 1]
    form = form * 4 + _ENDING[tail]
    form = form * 2 + ((head >= 65) & (head <= 90))
    form = form * 2 + ((tail >= 65) & (tail <= 90))
    by_form = (form * 16 + np.minimum(words.ends - words.starts, 15)).astype(np.int32) + int(FIRST[2])
    by_length = np.minimum(np.log2(n + 1), 31).astype(np.int32) + int(FIRST[3])
    each = np.arange(len(n))
    return [(by_word, words.first[:-1], words.first[1:]), (by_gram, lo, np.clip(offsets[1:] - 2, lo, k)), (by_form, words.first[:-1], words.first[1:]), (by_length, each, each + 1)], n


def _means(weights: np.ndarray, index: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mean weight of each text's features; 0 without any."""
    total = np.zeros(len(index) + 1)
    np.cumsum(weights[index], out=total[1:])
    return (total[hi] - total[lo]) / np.maximum(1, hi - lo)


@dataclass
class Model:
    """P(grade > k) = logistic(score - thresholds[k]); thresholds ascend."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score and the number of words of each text."""
        families, n_words = features(data, offsets)
        return sum(scale * _means(self.weights, *f) for scale, f in zip(SCALES, families, strict=True)), n_words

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... by column."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Full-batch Adam on the cumulative-link likelihood; rows: (feature numbers, values) of each text.

    Thresholds are a first one and gaps through an exponential, so they stay
    ordered. Features are held once, in single precision; rows is emptied.
    """
    size, k = SIZE, int(grades.max(initial=0))
    if k < 1 or len(np.unique(grades)) < 2:
        return Model(np.zeros(size), np.full(max(1, k), -10.0 if grades.min(initial=1) else 10.0))
    index = np.concatenate([r[0] for r in rows]).astype(np.int32, copy=False)
    value = np.concatenate([r[1] for r in rows]).astype(np.float32, copy=False)
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    n = len(rows)
    rows.clear()
    share = np.clip([(grades > j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(1e-2, np.diff(start)))
    w, first = np.zeros(size), start[0]
    p = [w, np.array([first]), gaps]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    balance = 1 / np.maximum(1, np.bincount(grades, minlength=k + 1))
    row_weight = np.sqrt(balance[grades])
    row_weight /= row_weight.sum()
    for t in range(1, rounds + 1):
        s = np.bincount(doc, value * p[0].astype(np.float32)[index], n)
        theta = np.cumsum(np.concatenate([p[1], np.exp(p[2])]))
        upper = np.concatenate([theta, [np.inf]])[grades] - s
        lower = np.concatenate([[-np.inf], theta])[grades] - s
        cu, cl = 1 / (1 + np.exp(np.clip(-upper, -500, 500))), 1 / (1 + np.exp(np.clip(-lower, -500, 500)))
        du, dl = cu * (1 - cu), cl * (1 - cl)
        like = np.maximum(cu - cl, 1e-12)
        gs = row_weight * (du - dl) / like  # of the loss by score
        gu, gl = -row_weight * du / like, row_weight * dl / like
        gt = np.array([gu[grades == j].sum() + gl[grades == j + 1].sum() for j in range(k)])
        tail = np.cumsum(gt[::-1])[::-1]
        grads = [np.bincount(index, value * gs.astype(np.float32)[doc], size) + DECAY * p[0], tail[:1], tail[1:] * np.exp(p[2])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    return Model(p[0], np.cumsum(np.concatenate([p[1], np.exp(p[2])])))


def bounded(rated: DataFrame, most: int) -> DataFrame:
    """The rows of rated with the smallest hash of doc_id: at most that many, and the same each time."""
    return rated.where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, rated: DataFrame, most: int = SAMPLE) -> Model:
    """Fits on at most ``most`` rows of rated (doc_id, grade >= 0); their features are made on the executors."""
    sample = bounded(rated.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("grade >= 0"), most)
    src = docs.select(F.col("doc_id").cast("long").alias("d"), whole("text").alias("text"))
    joined = src.join(F.broadcast(sample), src["d"] == sample["doc_id"]).select("doc_id", "grade", "text")  # at most SAMPLE rows of 12 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, data, offsets in slices(b.column(2)):
                families, _ = features(data, offsets)
                index, value = [], []
                for i in range(e - a):
                    at = [(*np.unique(f[lo[i] : hi[i]], return_counts=True), scale / max(1, hi[i] - lo[i])) for scale, (f, lo, hi) in zip(SCALES, families, strict=True)]
                    index.append(np.concatenate([u for u, _, _ in at]))
                    value.append(np.concatenate([n * x for _, n, x in at]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), b.column(1).slice(a, e - a), pa.array([x.astype("<i4").tobytes() for x in index], pa.binary()), pa.array([x.astype("<f4").tobytes() for x in value], pa.binary())], names=["doc_id", "grade", "at", "value"])

    got = joined.mapInArrow(run, "doc_id long, grade int, at binary, value binary").toArrow().sort_by("doc_id")
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4")) for a, v in zip(got.column("at").to_pylist(), got.column("value").to_pylist(), strict=True)]
    grades = got.column("grade").to_numpy().astype(np.int64)
    del got
    return fit(rows, grades) if rows else Model(np.zeros(SIZE), np.array([-10.0]))


def graded(rated: DataFrame) -> DataFrame:
    """Grades from labels: 0 for quality 0, 1 for quality 1 but toxic, 2 for quality 1 and not toxic."""
    return rated.select("doc_id", F.when(F.col("quality") > 0, F.when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)).otherwise(0).alias("grade"))


def assess(docs: DataFrame, model: Model, keep: bool = False, grade: int = GRADE, tail: float = TAIL) -> DataFrame:
    """docs with __expected (grade), __tail (P of at least grade) and __kept; with keep, the rows kept with docs' columns only.

    One pass, no shuffle, whole texts; a text goes once through Arrow, and
    results leave in parts of OUT_ROWS rows. A text without a word, null or empty,
    has expected grade and tail 0 and is not kept. Ties at the threshold are kept.
    All columns of docs are handed on, whatever their names; where docs has a
    column of the name, a new one gets further underscores in front. Each row is
    judged alone.
    """
    spark = docs.sparkSession
    on_tasks = spark.sparkContext.broadcast(model)
    d, columns = numbered(docs)
    at = list(columns).index("text")
    more = [] if keep else ["expected", "tail", "kept"]
    schema = StructType([*d.schema.fields, *(StructField(c, t) for c, t in zip(more, (DoubleType(), DoubleType(), BooleanType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = on_tasks.value
        for b in batches:
            for lo in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(lo, OUT_ROWS)
                expected, reach = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for a, e, data, offsets in slices(part.column(at)):
                    score, n_words = model.score(data, offsets)
                    tails = model.tails(score)
                    expected[a:e] = np.where(n_words > 0, tails.sum(1), 0)
                    reach[a:e] = np.where(n_words > 0, tails[:, min(grade, tails.shape[1]) - 1], 0)
                kept = pa.array(reach >= tail)
                yield part.filter(kept) if keep else pa.RecordBatch.from_arrays([*part.columns, pa.array(expected), pa.array(reach), kept], names=[*part.schema.names, *more])

    out = d.mapInArrow(run, schema)
    return out.select(*restored(columns), *(F.col(c).alias(n) for c, n in zip(more, fresh(docs, *(f"__{c}" for c in more)), strict=True)))


def select_good(docs: DataFrame, rated: DataFrame) -> DataFrame:
    """The rows of docs that the classifier fitted on rated keeps, with their columns."""
    return assess(docs, train(docs, graded(rated)), keep=True)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, graded(labels(spark, sf_dir)))
    return assess(docs, model).select("doc_id", F.col("__expected").alias("expected_grade"), F.col("__tail").alias("p_good"), F.col("__kept").alias("kept"))
