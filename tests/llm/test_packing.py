import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridweave.llm import packing
from tests.llm.odd_rows import ROWS, table


MARKED = """the&&& of%%% <|endoftext|>! x|> x<| (paren) "q" a-b rock'n' it's' 'tis y' [z] {w}; İstanbul ŉa ǅungla STRASSE ﬁne naïve. ... ?! a1b2 été's l'été ÇA, Ñandu\u0301 e\u0301a ẞ ª º µ Ünder/Über=1 <|endoftext|>a a<|endoftext|> ЖЖ. 漢字, \u200b"""


def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(40, 60))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    plan = packing.best_fit(dict(Counter(lengths)), capacity)
    placed, fill, seen = [], Counter(), Counter()
    for length, rank, n, first, offset in plan.tolist():
        for k in range(n):
            placed.append((length, rank + k))
            seen[length] += 1
            fill[first + k] += length
            assert offset + length <= capacity
    assert seen == Counter(lengths)
    assert len(set(placed)) == len(lengths)
    assert all(v <= capacity for v in fill.values())
    assert len(fill) == brute_best_fit(lengths, capacity)


def expected_pieces(rows, capacity):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [packing.END]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out.append((i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return Counter(out)


def check(got, rows, capacity):
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected_pieces(rows, capacity)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by) == brute_best_fit([r.length for r in got], capacity)


def test_pack_odd_rows(spark):
    rows = [*ROWS, (30, "It's <|endoftext|> a<|startoftext|>b  don't ΣΑΣ ＡＢ éx", None, None, None)]
    check(packing.pack(table(spark, rows)).collect(), [r[:2] for r in rows], packing.CAPACITY)


def test_pack_on_table_with_small_capacity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(packing.pack(docs, capacity=700).collect(), [(r.doc_id, r.text) for r in docs.collect()], 700)


def test_pack_empty(spark):
    assert packing.pack(table(spark, [])).collect() == []


def test_encoder_forgets_and_remembers(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "REMEMBERED", 600)
    e = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    texts = [b"one two three four", b"five six", b"one six seven"]
    fresh = packing.Encoder(public_tokenizers.path(packing.VOCABULARY))
    assert list(e.encode(texts)) == [next(fresh.encode([t])) for t in texts]
