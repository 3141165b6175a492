import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridweave.llm import exact, mixing
from tests.llm.odd_rows import ROWS, SCHEMA, table

WS = re.compile(r"[\x20\x09-\x0D]")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[WS.sub("", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t, *_ in rows:
        n = WS.sub("", t or "")
        best = min(groups[n], key=lambda x: x[:3])
        out.append((i, best[3], len(groups[n]), i == best[3] and -len(t or "") == best[0], hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


def test_exact_odd_rows(spark):
    assert Counter(map(tuple, exact.exact_groups(table(spark)).collect())) == brute_exact(ROWS)


def test_exact_on_table(spark, sf_dir, duck, same_rows):
    same_rows(exact.query(spark, sf_dir), duck.sql(exact.ORACLE))


def test_exact_empty(spark):
    assert exact.exact_groups(table(spark, [])).collect() == []
    assert exact.drop_exact(table(spark, [])).collect() == []


def test_colliding_identifiers_fall_back_to_digests(spark, monkeypatch):
    monkeypatch.setattr(exact, "_ids", lambda c: F.struct(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b")))
    assert Counter(map(tuple, exact.exact_groups(table(spark)).collect())) == brute_exact(ROWS)


def test_drop_exact_keeps_columns_and_rows_without_id(spark):
    docs = table(spark)
    out = exact.drop_exact(docs)
    assert out.columns == docs.columns
    assert None in [r.doc_id for r in out.collect()]


COPIES = [
    *((None, "a text without an id", "en", "a", None) for _ in range(3)),
    *((None, " \ta b", "en", x, None) for x in "ab"),
    (None, "a b\t ", "en", "a", None),
    *((8, "repeated with its id", "en", "a", None) for _ in range(3)),
    (20, "one id, two texts: only this copy goes", "en", "a", None),
    (20, "a text of its own", "en", "a", None),
    (3, "one id, two texts: only this copy goes", "en", "a", None),
    (21, None, "en", "a", None),
    (None, "", "en", "a", None),
    (22, "x", "en", "a", None),
]


def test_drop_exact_keeps_one_row_of_each_group(spark):
    out = exact.drop_exact(table(spark, COPIES)).collect()
    norm = lambda t: WS.sub("", t or "")
    assert Counter(norm(r.text) for r in out) == Counter({norm(t) for _, t, *_ in COPIES})
    ids = {norm(r.text): r.doc_id for r in out}
    assert ids[norm(COPIES[9][1])] == 3 and ids[norm(COPIES[10][1])] == 20 and ids[""] == 21
    assert len(exact.drop_exact(table(spark)).collect()) == len({norm(t) for _, t, *_ in ROWS})
    again = exact.drop_exact(table(spark, COPIES[::-1]).repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def brute_targets(sizes, weights=(5, 2, 1), budget=1.5, cap=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = budget * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mix_odd_rows(spark):
    rows = mixing.mix(table(spark, extra=False)).select("doc_id", "source", "__size", "__source_size", "__target", "__taken").collect()
    sizes = Counter()
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(sizes), Counter()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert 0 <= r["__taken"] <= 2 * r["__size"]
        assert r["__source_size"] == sizes[r.source]
        assert r["__target"] == pytest.approx(want[r.source])
        taken[r.source] += r["__taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_mix_on_table(spark, sf_dir, duck, same_rows):
    same_rows(mixing.query(spark, sf_dir), duck.sql(mixing.ORACLE))


def test_mix_without_broadcast_agrees(spark, sf_dir, monkeypatch):
    first = sorted(map(tuple, mixing.query(spark, sf_dir).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.query(spark, sf_dir).collect())) == first


def test_mixed_documents_hold_what_is_taken(spark):
    docs = table(spark)
    m = mixing.mixed_documents(docs)
    assert m.columns == docs.columns
    got = {r.source: r.w for r in m.groupBy("source").agg(F.sum(mixing.words_in("text")).alias("w")).collect()}
    want = {r.source: r.w for r in mixing.mix(docs).groupBy("source").agg(F.sum("___taken").alias("w")).collect() if r.w}
    assert got == want


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_running_sums_by_ranges(spark):
    df = spark.createDataFrame([(f"s{k:03d}" if k else None, k % 7) for k in range(200)], "source string, n long").repartition(5)
    by = [F.col("source").asc_nulls_last()]
    one, many = ({(r.source, r.a, r.b) for r in mixing._ahead(df, by, m, a=F.lit(1), b=F.col("n")).collect()} for m in (False, True))
    assert one == many and (None, 199, sum(k % 7 for k in range(1, 200))) in one


def test_null_ids_are_spread_by_their_texts(spark):
    rows = [(None, f"text number {k} of some words", "en", "a", None) for k in range(50)]
    places = spark.createDataFrame(rows, SCHEMA).select(mixing._place("doc_id", "text", "s").alias("p")).distinct()
    assert places.count() == 50
