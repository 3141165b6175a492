"""Best-fit decreasing packing of token sequences, with a segment tree over remaining capacities."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, whole

CAPACITY, END = 4096, 1
VOCABULARY = "word_bpe_49k.json"
#: Bytes that a worker's memory of words, and its memory of stems, may take (twice as many at most, in two generations), and those of an entry besides its contents.
REMEMBERED, ENTRY = 20_000_000, 170
#: Rows that a task tokenizes and hands back at once.
OUT_ROWS = 500
#: ASCII marks: with none of them a letter, they are a token run of their own after a word's letters.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """Token ids of a text, as little-endian 32-bit words, by words between ASCII white space.

    The tokenizer drops white space and merges nothing across it, so the ids of a
    text are those of its words in turn; frequent words are encoded once. Within
    a word it parts letters from marks and folds case. A word of Latin letters
    below U+0250 and marks after them therefore goes straight to the merges, as
    stem and marks; any other word goes through the whole tokenizer. What was
    not used since a memory was last full is forgotten.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes | None] = {}
        self.old_stems: dict[bytes, bytes | None] = {}
        self.marks: dict[bytes, bytes] = {b"": b""}
        self.word_bytes = self.stem_bytes = self.mark_bytes = 0
        self.letters = dict(enumerate(_byte_letters()))

    def _whole(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, stem: bytes) -> bytes | None:
        """Ids of a run of letters in lower ASCII case, or None if it is not one that needs no more than folding."""
        text = stem.decode("utf-8", "replace")
        low = text.lower()
        if not text.isalpha() or max(text) >= "\u0250" or len(low) != len(text) or not low.isalpha():
            return None
        spelled = low.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], "<u4").tobytes()

    def _encode(self, word: bytes) -> bytes:
        stem = word.rstrip(_MARKS)
        low = stem.lower()
        ids = self.stems.get(low, b"")  # no stem has no ids
        if ids == b"":
            ids = self.old_stems.get(low, b"")
        if ids == b"":
            ids = self._stem(low) if low else None
        if low not in self.stems:
            self.stems[low] = ids
            self.stem_bytes += ENTRY + len(low) + len(ids or b"")
        if ids is None:
            return self._whole(word)
        marks = word[len(stem) :]
        tail = self.marks.get(marks)
        if tail is None:
            tail = self.marks[marks] = self._whole(marks)
            self.mark_bytes += ENTRY + len(marks) + len(tail)
        return ids + tail

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for t in texts:
            words = t.split()
            known, old = self.words, self.old_words
            for w in set(words).difference(known):
                ids = old.get(w)
                if ids is None:
                    ids = self._encode(w)
                known[w] = ids
                self.word_bytes += ENTRY + len(w) + len(ids)
            yield b"".join(map(known.__getitem__, words))
            if self.word_bytes > REMEMBERED:
                self.old_words, self.words, self.word_bytes = known, {}, 0
            if self.stem_bytes > REMEMBERED:
                self.old_stems, self.stems, self.stem_bytes = self.stems, {}, 0
            if self.mark_bytes > REMEMBERED:
                self.marks, self.mark_bytes = {b"": b""}, 0


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary; workers serve many tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every whole text: doc_id, piece, start, length, ids_crc32, task, place.

    A document is its ids and then END; only one that is longer than capacity is
    cut, into full pieces and a last one. place numbers the pieces of a length
    within the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        encode = encoder(path or public_tokenizers.path(VOCABULARY)).encode
        task, made = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, width = np.array([END], "<u4").tobytes(), 4 * capacity
        for b in (part.slice(lo, OUT_ROWS) for part in batches for lo in range(0, part.num_rows, OUT_ROWS)):
            rows, ids_of = [], b.column(0).to_pylist()
            for doc, ids in zip(ids_of, encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    n = len(part) // 4
                    rows.append((doc, k // width, k // 4, n, zlib.crc32(part), task, made[n]))
                    made[n] += 1
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").cast("binary").alias("text")).mapInArrow(run, schema)


class Capacities:
    """A segment tree over remaining capacities: each leaf counts the open bins with that much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, count: int) -> None:
        i = room + self.size
        while i:
            self.tree[i] += count
            i //= 2

    def tightest(self, length: int) -> int:
        """The smallest room of at least length that an open bin has, or -1; logarithmic time."""
        i, tree = length + self.size, self.tree
        if tree[i]:
            return length
        while i > 1:
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing for counts of pieces by length.

    Bins with equal room are alike, so those of one room move together as ranges
    of bin numbers, and the work depends on capacity, not on how many pieces
    there are. Returns rows (length, first rank, count, first bin, offset): the
    pieces of a length, by rank, go one each into a range of bins.
    """
    tree, bins, opened, out = Capacities(capacity), {}, 0, []

    def put(room: int, first: int, count: int) -> None:
        if room:
            bins.setdefault(room, deque()).append((first, count))
            tree.add(room, count)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room < 0:  # open bins for the rest: as many in each as fit
                per = capacity // length
                full, odd = divmod(left, per)
                for n, k in ((full, per), (1, odd)):
                    if n and k:
                        for j in range(k):
                            out.append((length, rank, n, opened, j * length))
                            rank += n
                        put(capacity - k * length, opened, n)
                        opened += n
                break
            first, count = bins[room].popleft()
            n = min(left, count)
            tree.add(room, -n)
            if n < count:
                bins[room].appendleft((first + n, count - n))
            out.append((length, rank, n, first, capacity - room))
            put(room - length, first, n)
            rank, left = rank + n, left - n
    return np.array(out, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs every document's pieces into sequences of at most capacity tokens.

    The packing is one best-fit decreasing run over all pieces. It needs only
    how many pieces have each length (capacity numbers at most, whatever the
    input), so the driver plans it on that histogram; tasks then find each
    piece's bin by its rank among those of its length, in logarithmic time. Ranks
    come from the places within tasks and running counts of tasks, so that no
    length's pieces are gathered. Pieces are tokenized once and written to the
    shared folder, which fixes their ranks if a task is run again.

    Null text counts as empty and gives one piece, END alone. Repeated rows are
    packed each. Other columns of docs are ignored; no rows give no rows.
    """
    made = materialize(pieces(docs, path, capacity))
    spark = docs.sparkSession
    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = by_task.select(F.col("length").alias("b_length"), F.col("task").alias("b_task"), (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    plan = best_fit({r.length: r.n for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan_on_tasks = spark.sparkContext.broadcast(plan[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = plan_on_tasks.value
        span = int((plan[:, 1] + plan[:, 2]).max()) + 1 if len(plan) else 1
        keys = plan[:, 0] * span + plan[:, 1]  # below 2**63 up to 10**15 pieces of a length
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy() + b.column(6).to_numpy()
            row = plan[np.searchsorted(keys, length * span + rank, "right") - 1] if b.num_rows else plan[:0]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = made.join(before, (made["length"] == before["b_length"]) & (made["task"] == before["b_task"])).select("doc_id", "piece", "start", "length", "ids_crc32", "place", "before")
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
