"""Whole-batch text kernels on numpy, shared by the Arrow operators.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; as these are
ASCII, splitting UTF-8 bytes and splitting code points give the same words.
A batch is cut into slices of about ``SLICE`` bytes, so the scratch arrays stay
small however many rows Arrow delivers; one longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 500_000
LONG_WORD = 512

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_BYTE = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSE = tuple(pow(b, -1, 2**64) for b in _BASE)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """The first n powers of a base, or of its inverse, modulo 2**64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        size = max(n, SLICE + 1)
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64((_INVERSE if inverse else _BASE)[which])
        np.multiply.accumulate(have, out=have)
        if size <= 4 * SLICE:
            _powers[which, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64; a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Word boundaries of a slice of texts.

    data: bytes of all texts; offsets: byte range of each text; starts, ends:
    byte range of each word; first: index of each text's first word (len + 1).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        ink = ~_WS[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = True
            np.logical_not(ink[:-1], out=before[1:])
            before |= edge[:n]
            after[-1] = True
            np.logical_not(ink[1:], out=after[:-1])
            after |= edge[1:]
        self.starts = np.flatnonzero(ink & before)
        self.ends = np.flatnonzero(ink & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; which: one of two families."""
        data = _LOWER[self.data] if lower else self.data
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[which][data] * powers(which, False, len(data)), out=total[1:])
        out = mix((total[self.ends] - total[self.starts]) * powers(which, True, len(data) + 1)[self.starts] + (self.ends - self.starts).astype(np.uint64))
        for i in np.flatnonzero(self.ends - self.starts > LONG_WORD):  # a polynomial modulo 2**64 is weak on long runs
            out[i] = xxhash.xxh64_intdigest(data[self.starts[i] : self.ends[i]].tobytes(), which + 1)
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def runs(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every run of k word hashes, by its first word (len - k + 1, at least 0)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(which, False, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(which, True, n - k + 1))


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about SLICE bytes; null counts as empty."""
    for start, chunk in _chunks(texts):
        offsets = np.frombuffer(chunk.buffers()[1], np.int64, len(chunk) + 1 + chunk.offset)[chunk.offset :]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)
        a, n = 0, len(chunk)
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE, "right")) - 1)
            b = min(b, n)
            yield start + a, start + b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b


def _chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, pa.Array]]:
    at = 0
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        if chunk.null_count:
            chunk = chunk.fill_null("")
        yield at, chunk.cast(pa.large_binary())
        at += len(chunk)
