import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from gridweave.llm import components, simhash, substrings, text
from tests.llm.odd_rows import ROWS, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(t):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    hashes = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a) <= simhash.RADIUS):
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def check_near(got, rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components([i for i, _ in rows], fps)
    want = Counter((i, f, c) for (i, _), f, c in zip(rows, fps, comp))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want


def test_near_odd_rows(spark):
    check_near(simhash.near_duplicates(table(spark)).collect(), [r[:2] for r in ROWS])


def test_near_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_near(simhash.near_duplicates(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_keep_first_keeps_one_row_of_each_component(spark):
    other, long = "quite different words stand here one after the other", "the first of some words that are met more than once"
    rows = [(i, t, "en", s, None) for i, t, s in [(None, other, "a"), (None, other, "b"), (None, other.upper(), "a"), (5, long, "a"), (5, long, "a"), (6, long.upper(), "a"), (6, "but these have the same id and are on their own", "a"), (None, long, "a")]]
    out = simhash.keep_first(table(spark, rows))
    fps = [brute_fingerprint(r.text) for r in out.collect()]
    assert sorted(fps) == sorted({brute_fingerprint(t) for _, t, *_ in rows}) and len(fps) == 3
    assert Counter(r.doc_id for r in out.collect()) == Counter([None, 5, 6])


def test_near_empty(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []


@pytest.mark.parametrize("hot", [False, True])
def test_links_of_dense_and_random_fingerprints(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(simhash, "MOST", (3, 5, 1 << 19))
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 2**64, 150, dtype=np.uint64)}
    for base in list(fps)[:12]:
        for _ in range(12):
            x = base
            for b in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    found = components.components(simhash.links(spark.createDataFrame(signed, "fp long")))
    root = {r.node % 2**64: r.root % 2**64 for r in found.collect()}
    groups = Counter()
    for i, c in zip(fps, brute_components(list(range(len(fps))), fps)):
        groups[c, root.get(i, i)] += 1
    assert len(groups) == len({c for c, _ in groups}) == len({r for _, r in groups})


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)} | {200: 200, 201: 200}


def brute_repeats(rows, window):
    seen = Counter()
    words = [WORDS.findall(t or "") for _, t in rows]
    for w in words:
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def check_repeats(df, rows, window=35):
    got = df.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == brute_repeats(rows, window)
    for r in got:
        assert sum(b - a for a, b in r.spans) == r.n_removed


SHARED = " ".join(f"p{i}" for i in range(60))
PASSAGES = [*(r[:2] for r in ROWS), (20, "a b " * 60), (21, SHARED), (22, "x " + SHARED + " y " + SHARED[:200]), (23, " ".join(f"p{i}" for i in range(20, 55))), (24, " ".join(f"p{i}" for i in range(20, 54)))]


@pytest.mark.parametrize("cut", [False, True])
def test_repeats_odd_rows(spark, monkeypatch, cut):
    if cut:
        monkeypatch.setattr(substrings, "HOT_ROWS", 2)
        monkeypatch.setattr(substrings, "HOT_SHARE", 0)
        monkeypatch.setattr(substrings, "PART", 4)
    rows = [(i, t, None, None, None) for i, t in PASSAGES]
    check_repeats(substrings.remove_repeats(table(spark, rows)), PASSAGES)


def test_repeats_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_repeats(substrings.remove_repeats(docs), [(r.doc_id, r.text) for r in docs.collect()])


def test_repeats_empty(spark):
    assert substrings.remove_repeats(table(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t.", max_size=30), min_size=1, max_size=6))
def test_words_of_a_slice(texts):
    import pyarrow as pa

    for a, b, data, offsets in text.slices(pa.array(texts)):
        w = text.Words(data, offsets)
        want = [WORDS.findall(t) for t in texts[a:b]]
        assert w.counts.tolist() == list(map(len, want))
        assert [w.word(i).decode() for i in range(len(w.starts))] == [x for d in want for x in d]
        h = w.hashes()
        flat = [x for d in want for x in d]
        assert len(set(h.tolist())) == len(set(flat))


def test_repeats_of_rows_with_one_text_and_no_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "a", None)] * 5 + [(4, "x " + text, "en", "a", None), (4, "x " + text, "en", "a", None)]
    check_repeats(substrings.remove_repeats(table(spark, rows)), [r[:2] for r in rows])
