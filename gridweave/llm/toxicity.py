"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, labels, materialize, whole
from .ordinal import bounded

#: Labelled rows used, at most.
SAMPLE = 20_000
PREDICT = 0.7
#: Terms of the learned lexicon at most; a term is a word or a stem of 3 to 6 letters.
TERMS, STEMS = 2000, range(3, 7)
#: A term must be this many times as frequent among toxic documents, and be in so many of them.
LIFT, SUPPORT, SUPPORT_SHARE = 25.0, 3, 0.004
TREES, DEPTH, RATE, BINS, NEAR = 60, 3, 0.2, 32, 5

#: Insults of everyday English, before any are learned.
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns imbecile cretin dimwit jerk".split())
SECOND_PERSON = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
FEATURES = ["insults", "insult_rate", "words_learned", "word_rate", "stems_learned", "stem_rate", "near_second_person", "second_person_rate", "disguised", "capitals", "exclamations", "symbols", "digits", "log_words"]

_LETTERS = re.compile(r"[^\W\d_]+")
_DISGUISE = str.maketrans("013457@$!|*", "oieastasiil")


@dataclass
class Lexicon:
    words: frozenset
    stems: frozenset

    def codes(self, raw: str) -> int:
        """Bits of a word: 1 insult, 2 learned word, 4 learned stem, 8 second person, 16 insult in disguise."""
        code, low = 0, raw.lower()
        for w in _LETTERS.findall(low):
            code |= (w in INSULTS) | 2 * (w in self.words) | 8 * (w in SECOND_PERSON)
            if any(w[:k] in self.stems for k in STEMS):
                code |= 4
        if not code & 3:
            plain = "".join(_LETTERS.findall(low.strip(".,;:!?\"'()").translate(_DISGUISE)))
            if plain != low and plain in (INSULTS | self.words) and not low.isalpha():
                code |= 16
        return code


class _Codes(dict):
    """Codes by word, remembered for frequent words."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, raw: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        code = self[raw] = self.lexicon.codes(raw.decode("utf-8", "replace"))
        return code


_KINDS = np.zeros((256, 4), np.int64)  # capitals, exclamation marks, symbols, digits
_KINDS[65:91, 0] = 1
_KINDS[ord("!"), 1] = 1
_KINDS[list(b"#*$%&|<>@^~"), 2] = 1
_KINDS[48:58, 3] = 1


def text_features(text: bytes, codes: dict) -> list[float]:
    """The numbers of FEATURES for a text; all 0 without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.fromiter(map(codes.__getitem__, words), np.int64, n)
    hit = np.flatnonzero(c)
    bits = {b: hit[c[hit] & b > 0] for b in (1, 2, 4, 8, 16)}
    bad = hit[c[hit] & 23 > 0]
    you = bits[8]
    near = 0
    if len(bad) and len(you):
        i = np.searchsorted(you, bad)
        left = np.abs(bad - you[np.maximum(i - 1, 0)])
        right = np.abs(you[np.minimum(i, len(you) - 1)] - bad)
        near = int((np.minimum(left, right) <= NEAR).sum())
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _KINDS
    size = len(text)
    a, b, s, d = (len(bits[k]) for k in (1, 2, 4, 16))
    return [a, 100 * a / n, b, 100 * b / n, s, 100 * s / n, near, 100 * len(you) / n, d, *(100 * kinds / size).tolist(), float(np.log1p(n))]


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Boosted trees on the logistic loss: complete binary trees as arrays, splits at quantiles, second-order leaves."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for c in x.T]
    edges = [np.unique(np.concatenate([e, [0.0]])) for e in edges]  # a count of 0 is always told apart
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    width = max(map(len, edges)) + 1
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    score, out = np.full(len(y), prior), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for f in range(x.shape[1]):
                slot = (node - first) * width + binned[:, f]
                gs = np.bincount(slot, g, n * width).reshape(n, width).cumsum(1)
                hs = np.bincount(slot, h, n * width).reshape(n, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < 0.5) | (ht - hs < 0.5)] = 0
                at = gain[:, : len(edges[f])].argmax(1)
                top = gain[np.arange(n), at]
                for i in np.flatnonzero(top > best):
                    best[i], feature[first + i], cut[first + i] = top[i], f, edges[f][at[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + 1)
        score = score + value[leaf]
        out.append((feature, cut, value))
    return {"prior": prior, "depth": depth, "trees": out}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    score, rows = np.full(len(x), model["prior"]), np.arange(len(x))
    for feature, cut, value in model["trees"]:
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        score += value[node - (2 ** model["depth"] - 1)]
    return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, values) of a non-decreasing map, for linear interpolation.

    Each pool counts half an unlike label besides its own, so that no value is 0 or 1.
    """
    at, of = np.unique(score, return_inverse=True)
    pools: list[list[float]] = []  # value's sum, weight, first and last score
    for s, v, n in zip(at, np.bincount(of, y, len(at)), np.bincount(of, minlength=len(at)), strict=True):  # equal scores are one
        pools.append([float(v), float(n), s, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    mean = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    xs, vs = [], []
    for total, n, a, b in pools:
        v = (total + 0.5 * mean) / (n + 0.5)
        for at in (a, b) if b > a else (a,):
            xs.append(at)
            vs.append(v)
    return np.array(xs), np.maximum.accumulate(np.array(vs)) if vs else np.array(vs)


@dataclass
class Model:
    lexicon: Lexicon
    trees: dict
    xs: np.ndarray
    values: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.xs):
            return np.zeros(len(x))
        return np.clip(np.interp(margins(self.trees, x), self.xs, self.values), 0, 1)


def fold(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 3; rows with 1 are held out. Null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, t0, n0, t1, n1: toxic rows and all rows of either part that have a word or stem; the empty term counts all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, toxic, parts = [], [], []
            for t, y, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = set(_LETTERS.findall(t.lower()))
                own = words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k} | {""}
                terms += own
                toxic += [y] * len(own)
                parts += [part] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(toxic, pa.int64()), pa.array(parts, pa.int64())], names=["term", "toxic", "part"])

    found = rows.select("text", "toxic", "part").mapInArrow(run, "term string, toxic long, part long")
    of = lambda p, c: F.sum(F.when(F.col("part") == p, c).otherwise(0))
    return found.groupBy("term").agg(of(0, F.col("toxic")).alias("t0"), of(0, F.lit(1)).alias("n0"), of(1, F.col("toxic")).alias("t1"), of(1, F.lit(1)).alias("n1"))


def _lexicon(counts: DataFrame, parts: tuple[int, ...]) -> Lexicon:
    """Words and stems far more frequent among the toxic rows of some parts, and found in each part."""
    t, n = (sum(F.col(f"{c}{p}") for p in parts) for c in "tn")
    everywhere = F.least(*(F.col(f"t{p}") for p in parts)) if len(parts) > 1 else t
    own = counts.select("term", t.alias("t"), n.alias("n"), everywhere.alias("least"))
    total = own.where("term = ''").first()
    if total is None or not total.t or total.t == total.n:
        return Lexicon(frozenset(), frozenset())
    bad, good = total.t, total.n - total.t
    lift = (F.col("t") / bad) / ((F.col("n") - F.col("t") + 0.5) / good)
    found = own.where((F.col("term") != "") & (F.col("least") > 0) & (F.col("t") >= max(SUPPORT, SUPPORT_SHARE * bad)) & (lift >= min(LIFT, SUPPORT * good / bad)))
    found = found.withColumn("lift", lift).orderBy(F.desc("t"), F.desc("lift"), "term").limit(TERMS).collect()
    return Lexicon(frozenset(r.term for r in found if r.term[-1] != "*"), frozenset(r.term[:-1] for r in found if r.term[-1] == "*"))


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """From (text, toxic, part): the lexicons of part 0, of part 1 and of both, from one count on the executors."""
    counts = materialize(_term_counts(rows).where(f"t0 + t1 >= {SUPPORT} or term = ''"))
    return [_lexicon(counts, parts) for parts in ((0,), (1,), (0, 1))]


def _sample(docs: DataFrame, rated: DataFrame, most: int) -> DataFrame:
    """doc_id, toxic, part (0 or 1) and text of at most ``most`` labelled rows that are not held out."""
    rated = rated.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic")).where("toxic is not null").where(fold() != 1)
    sample = bounded(rated, most).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)))
    src = docs.select(F.col("doc_id").cast("long").alias("d"), whole("text").alias("text"))
    return src.join(F.broadcast(sample), src["d"] == sample["doc_id"]).select("doc_id", "toxic", "part", "text")  # at most SAMPLE rows of 24 bytes


def train(docs: DataFrame, rated: DataFrame, most: int = SAMPLE) -> Model:
    """Fits on at most ``most`` labelled rows (doc_id, toxic) outside the held-out fold.

    The trees see each half of the rows through the lexicon of the other half, so
    that terms that are frequent by chance earn no trust; scoring uses the
    lexicon of both. Scores for the calibration come from trees that have not
    seen their rows (five folds).
    """
    rows = _sample(docs, rated, most)
    lexicons = learn_lexicons(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = {0: _Codes(lexicons[1]), 1: _Codes(lexicons[0])}
        for b in batches:
            x = [text_features(t, codes[p]) for t, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = rows.select("doc_id", "toxic", F.col("text").cast("binary").alias("text"), "part").mapInArrow(run, "doc_id long, toxic long, x array<double>").toArrow().sort_by("doc_id")
    lexicon = lexicons[2]
    x, y = np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES)), got.column("toxic").to_numpy().astype(float)
    if not len(y):
        return Model(lexicon, {"prior": 0.0, "depth": DEPTH, "trees": []}, np.zeros(0), np.zeros(0))
    part, unseen = np.arange(len(y)) % 5, np.zeros(len(y))
    for k in range(5):
        if (part == k).any() and (part != k).any():
            unseen[part == k] = margins(grow(x[part != k], y[part != k]), x[part == k])
    return Model(lexicon, grow(x, y), *isotonic(unseen, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score of every row; one pass, no shuffle, whole texts.

    Null, empty and wordless texts have all features 0 and the score that goes
    with them; a null doc_id is as the empty text for the fold. Other columns of
    docs are ignored.
    """
    on_tasks = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = on_tasks.value
        codes = _Codes(model.lexicon)
        for b in batches:
            x = np.array([text_features(t, codes) for t in b.column(2).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 1).alias("held_out"), whole("text").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return score(docs, train(docs, labels(spark, sf_dir))).withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))
