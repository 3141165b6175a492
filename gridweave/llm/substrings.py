"""Substring deduplication by seed and extend over winnowed anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, whole
from .text import Words, mix, runs, slices

WINDOW, GRAM = 35, 12
#: Bits of the sketch of repeated anchors: 8 MB whatever the input.
SKETCH_BITS = 26
#: An anchor with more than this share of all anchors, and at least HOT_ROWS, is dealt over groups of about HOT_ROWS rows, SALTS at most.
HOT_SHARE, HOT_ROWS, SALTS = 1 / 10_000, 2_000, 4096
#: Rows of one group that a task holds at once.
PART = 200_000

_POSITION = np.uint64(22)


def _seeds(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside a text: its first word, its own anchor's word, the anchor's hash, the window's hash.

    A window's own anchor is its smallest run of gram words, the leftmost of
    equal ones: it depends on the window's words alone, so equal windows have
    equal anchors at equal offsets.
    """
    h = words.hashes()
    grams = runs(h, gram)
    spread = window - gram + 1
    if len(h) < window:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    out = []
    block = (1 << int(_POSITION)) - spread  # positions must fit below the hash bits
    for a in range(0, len(h) - window + 1, block):
        key = grams[a : a + block + spread - 1] >> _POSITION << _POSITION
        key = key | np.arange(len(key), dtype=np.uint64)
        n, m = 1, key
        while 2 * n <= spread:
            m = np.minimum(m[:-n], m[n:])
            n *= 2
        if n < spread:
            m = np.minimum(m[: len(m) - (spread - n)], m[spread - n :])
        out.append((m & np.uint64((1 << int(_POSITION)) - 1)).astype(np.int64) + a)
    own = np.concatenate(out)
    first = np.arange(len(own))
    inside = first + window <= np.repeat(words.first[1:], words.counts)[: len(own)]
    first, own = first[inside], own[inside]
    return first, own, grams[own], runs(words.hashes(1), window, 1)[first]


def _source(docs: DataFrame) -> DataFrame:
    """doc_id, rid (tells rows of one doc_id apart by their text) and the text's bytes."""
    text = whole("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.cast("binary").alias("text"))


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in slices(b.column(0)):
                _, own, anchor, _ = _seeds(Words(data, offsets), window, gram)
                new = np.append(True, own[1:] != own[:-1]) if len(own) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new].view(np.int64))], names=["anchor"])

    return _source(docs).select("text").mapInArrow(run, "anchor long")


def _sketch(repeated: DataFrame, bits: int) -> np.ndarray:
    """A bit map of the anchors that occur twice or more; its size is fixed by bits."""
    slot = F.shiftrightunsigned("anchor", 64 - bits)
    cells = repeated.select(F.shiftright(slot, 6).cast("int").alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(anchor, {64 - bits}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return out


def _occurrences(docs: DataFrame, sketch, window: int, gram: int, bits: int) -> DataFrame:
    """A row for each anchor that may be repeated: where it is, and the hashes of the windows that chose it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, busy, salts = sketch.value
        for b in batches:
            ids, rids = b.column(0), b.column(1).to_numpy()
            for a, _, data, offsets in slices(b.column(2)):
                words = Words(data, offsets)
                first, own, anchor, whole_hash = _seeds(words, window, gram)
                slot = anchor >> np.uint64(64 - bits)
                may = (seen[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
                first, own, anchor, whole_hash = first[may], own[may], anchor[may], whole_hash[may]
                if not len(own):
                    continue
                # a window's own anchor never moves left as the window moves right
                new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                text = np.searchsorted(words.first, own[new], "right") - 1
                salt = np.zeros(len(new), np.int32)
                if len(busy):
                    at = np.minimum(np.searchsorted(busy, anchor[new].view(np.int64)), len(busy) - 1)
                    hot = busy[at] == anchor[new].view(np.int64)
                    salt[hot] = (mix((rids[a + text] + own[new]).view(np.uint64)) % salts[at])[hot]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new].view(np.int64)), pa.array(salt), ids.take(pa.array(a + text)), pa.array(rids[a + text]), pa.array((first[new] - words.first[text]).astype(np.int32)), pa.array((own[new] - first[new]).astype(np.int32)), pa.LargeListArray.from_arrays(pa.array(np.append(new, len(own))), pa.array(whole_hash.view(np.int64))).cast(pa.list_(pa.int64()))],
                    names=["anchor", "salt", "doc_id", "rid", "first", "reach", "windows"],
                )

    return _source(docs).mapInArrow(run, "anchor long, salt int, doc_id long, rid long, first int, reach int, windows array<long>")


def _settle(rows: pa.Table, cut: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Matches the windows of whole groups; rows marked by cut belong to a group of which other parts exist."""
    anchor, salt, rid, first, reach = (rows.column(c).to_numpy() for c in ("anchor", "salt", "rid", "first", "reach"))
    lists = rows.column("windows").combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    hashes = lists.flatten().to_numpy().view(np.uint64)
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    k = np.arange(len(hashes)) - starts[row]
    off = reach[row] - k
    key = mix(mix(anchor.view(np.uint64) + salt.astype(np.uint64))[row] ^ mix(hashes + off.astype(np.uint64)))
    order = np.argsort(key)
    # windows are one only if anchor (12 words, one hash family), window (all words, another) and offset all agree
    new = np.append(True, key[order][1:] != key[order][:-1])
    for x in (anchor[row], hashes, off):
        new[1:] |= x[order][1:] != x[order][:-1]
    often = np.zeros(len(key), bool)
    often[order] = (np.diff(np.append(np.flatnonzero(new), len(key))) > 1)[np.cumsum(new) - 1]
    mask = np.bitwise_or.reduceat(often.astype(np.int64) << k, starts)

    def out(kind, at, anchor=None, reach=None, window=None, first=None, mask=None):
        n = len(at)
        fill = lambda x, t: pa.array(np.zeros(n, t) if x is None else x.astype(t))
        doc = rows.column("doc_id").combine_chunks().take(pa.array(at))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), fill(anchor, np.int64), fill(reach, np.int32), fill(window, np.int64), doc, pa.array(rid[at]), fill(first, np.int32), fill(mask, np.int64)], names=_MATCHED)

    at = np.flatnonzero(mask)
    yield out(0, at, first=first[at], mask=mask[at])
    if cut.any():
        lone = np.flatnonzero(cut[row] & ~often)
        marker = order[np.flatnonzero(new)]
        marker = marker[cut[row[marker]] & often[marker]]
        for kind, w in ((1, lone), (2, marker)):
            at = row[w]
            yield out(kind, at, anchor[at], off[w], hashes[w].view(np.int64), first[at] + k[w])


_MATCHED = ["kind", "anchor", "reach", "window", "doc_id", "rid", "first", "mask"]


def _matched(rows: DataFrame, salted: np.ndarray) -> DataFrame:
    """Extends the seeds of each anchor. Kind 0: an occurrence, and a bit for each of its windows that is repeated.

    Rows arrive sorted by anchor and salt. Instead of comparing all pairs of
    occurrences, a group is sorted by alignment and window, so it costs its own
    size. A group that is salted, or grows past PART rows, is matched in parts:
    the windows met once in a part (kind 1), and a marker for each met more often
    (kind 2), go to a second step.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        broken: tuple | None = None  # the group of which a part went out already

        def ends(t):
            return t.column("anchor")[-1].as_py(), t.column("salt")[-1].as_py()

        def settle(t):
            a, s = t.column("anchor").to_numpy(), t.column("salt").to_numpy()
            cut = np.isin(a, salted)
            if broken:
                cut |= (a == broken[0]) & (s == broken[1])
            yield from _settle(t, cut)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.concat_tables([*rest, pa.Table.from_batches([b])])
            last = ends(t)
            a, s = t.column("anchor").to_numpy(), t.column("salt").to_numpy()
            whole_rows = int(np.argmax((a == last[0]) & (s == last[1])))
            if whole_rows:
                yield from settle(t.slice(0, whole_rows))
            rest = [t.slice(whole_rows)]
            if rest[0].num_rows > PART:
                broken = last
                yield from settle(rest[0])
                rest = []
        if rest:
            yield from settle(rest[0])

    dealt = rows.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return dealt.mapInArrow(run, "kind byte, anchor long, reach int, window long, doc_id long, rid long, first int, mask long")


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, rid, first, mask: bit k of mask says that the window at word first + k also starts elsewhere.

    Seeds are winnowed anchors. Any two equal windows share one at one offset, so
    only anchors that occur twice can seed a match; a bit map of fixed size says
    which may (a false yes costs a row, and no match rests on it). Occurrences
    then meet by anchor and are extended both ways to each window that covers
    them. Anchors with a large share of the rows are dealt over salts, and one
    row at most for each of their windows and parts meets in a second step.
    """
    if not 0 <= window - gram < 63:
        raise ValueError("a window must be 0 to 62 words longer than its anchor")
    spark = docs.sparkSession
    counted = materialize(_anchors(docs, window, gram).groupBy("anchor").count().where("count > 1"))
    total = counted.agg(F.sum("count")).first()[0] or 0
    hot = counted.where(F.col("count") > max(HOT_ROWS, total * HOT_SHARE)).orderBy("anchor").collect()  # 1 / HOT_SHARE rows at most
    busy = np.array([r["anchor"] for r in hot], np.int64)
    salts = np.array([min(SALTS, -(-r["count"] // HOT_ROWS)) for r in hot], np.uint64)
    on_tasks = spark.sparkContext.broadcast((_sketch(counted, bits), busy, salts))
    found = materialize(_matched(_occurrences(docs, on_tasks, window, gram, bits), busy))
    cut = found.where("kind > 0").groupBy("anchor", "reach", "window").agg(F.collect_list(F.struct("kind", "doc_id", "rid", "first")).alias("at"))
    second = cut.where("size(at) > 1 or at[0].kind = 2").select(F.explode("at").alias("x")).where("x.kind = 1").select("x.doc_id", "x.rid", "x.first", F.lit(1).cast("long").alias("mask"))
    return found.where("kind = 0").select("doc_id", "rid", "first", "mask").union(second)


def covered(first: np.ndarray, mask: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Whether each word is in a window at one of first + k for the bits k of mask."""
    step = np.zeros(n_words + 1, np.int64)
    for k in range(int(mask.max()).bit_length()):
        at = np.unique(first[mask >> k & 1 > 0] + k)
        step[at] += 1
        np.add.at(step, np.minimum(at + window, n_words), -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and spans of every row.

    Every word that a repeated window covers goes; spans lists the maximal runs of
    such words as [first, end). kept_text holds the other words joined by one
    space. Null text has no words; texts shorter than window keep all; rows
    repeated in the table are repeats of each other. Other columns of docs are
    ignored; no rows give no rows.
    """
    found = repeats(docs, window, gram, bits)
    found = found.groupBy("doc_id", "rid", "first").agg(F.bit_or("mask").alias("mask"))  # rows repeated with one text bring one list
    per_doc = found.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("first", "mask")).alias("found")).select(F.col("doc_id").alias("f_doc"), F.col("rid").alias("f_rid"), "found")
    src = _source(docs)
    joined = src.join(per_doc, src["doc_id"].eqNullSafe(per_doc["f_doc"]) & (src["rid"] == per_doc["f_rid"]), "left").select("doc_id", "text", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            found = b.column(2)
            for i, text in enumerate(b.column(1).to_pylist()):
                words = text.split()
                spans, kept = [], words
                if found[i].is_valid:
                    first, mask = (c.to_numpy() for c in found[i].values.flatten())
                    gone = covered(first, mask, len(words), window)
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    spans = edges.reshape(-1, 2).tolist()
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace"), spans))
            n, r, t, s = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(t, pa.string()), pa.array(s, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, spans array<array<int>>")


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
