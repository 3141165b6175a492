import re
from collections import Counter

import numpy as np
import pytest

from gridweave.llm import ordinal, rules, toxicity
from tests.llm.odd_rows import ROWS, table

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"


def brute_base(t):
    t = t or ""
    w = WORDS.findall(t)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = [False] * len(w)
    for i in range(len(w) - 4):
        if runs[tuple(w[i : i + 5])] > 1:
            again[i : i + 5] = [True] * 5
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(again)


def check_base(got, rows):
    want = Counter()
    for i, t in rows:
        b = brute_base(t)
        want[(i, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_rules_odd_rows(spark):
    odd = [*(r[:2] for r in ROWS), (50, "a b c d e " * 3 + "\n\n \nline one\nline one\n line one\nline one"), (51, "#*$%&|<>" * 3), (52, "one\ntwo\none"), (53, "\none\n\none")]
    docs = table(spark, [(i, t, None, None, None) for i, t in odd])
    none = spark.createDataFrame([], "doc_id long, quality int")
    check_base(rules.judge(docs, rules.train(docs, none)).collect(), odd)


def test_rules_on_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = rules.judge(docs, rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    check_base(got, [(r.doc_id, r.text) for r in docs.collect()])


def test_rules_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rated = spark.read.parquet(f"{LARGER}/labels.parquet")
    got = rules.judge(docs, rules.train(docs, rated.where("doc_id % 2 = 0"))).collect()
    quality = {r.doc_id: r.quality for r in rated.where("doc_id % 2 = 1").collect()}
    seen = [(quality[r.doc_id], r.kept) for r in got if r.doc_id in quality and not r.base_failed]
    assert np.mean([k for q, k in seen if q]) > 0.98
    assert np.mean([not k for q, k in seen if not q]) > 0.9


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_rules_count_all_labelled_rows(spark, monkeypatch, most):
    from pyspark.sql import functions as F

    monkeypatch.setattr(rules, "BROADCAST_LABELS", most, raising=False)
    ids = spark.range(24_000).withColumnRenamed("id", "doc_id")
    docs = ids.select("doc_id", F.concat(F.md5(F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 3 > 0, " trusted words").otherwise(" others")).alias("text"))
    rated = ids.withColumn("quality", (F.col("doc_id") % 3 > 0).cast("int"))
    rows = docs.withColumn("fits", F.pmod(F.xxhash64(F.lit("target"), "doc_id"), F.lit(2)) == 0).collect()

    def columns(texts):
        raw = [t.encode() for t in texts]
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])

    good = rules.gram_counts(*columns([r.text for r in rows if r.fits and r.doc_id % 3]))
    raw = rules.gram_counts(*columns([r.text for r in rows]))
    share = np.maximum(raw, 0.5) / raw.sum()
    want = rules.Target(np.log((good + rules.PRIOR * share) / (good.sum() + rules.PRIOR) / share), 0.0)
    got = rules.train(docs, rated)
    assert np.allclose(got.ratio, want.ratio)
    scores = want.score(*columns([r.text for r in rows if not r.fits]))
    trusted = np.array([r.doc_id % 3 > 0 for r in rows if not r.fits])
    low, high = np.quantile(scores[trusted], 0.002), np.quantile(scores[~trusted], 0.95)
    assert got.threshold == pytest.approx((low + high) / 2 if high < low else low, abs=1 / 4096)


def test_scores_do_not_depend_on_slices(spark):
    import pyarrow as pa

    from gridweave.llm import text

    texts = ["abcd efgh", "", "xyz", "a b c d e f g", "ab"]
    target = rules.Target(np.random.default_rng(1).normal(size=1 << rules.BITS), 0.0)
    model = ordinal.Model(np.random.default_rng(2).normal(size=ordinal.SIZE), np.array([0.0]))
    (_, _, data, offsets), = text.slices(pa.array(texts))
    for i, t in enumerate(texts):
        (_, _, d1, o1), = text.slices(pa.array([t]))
        assert rules.Target.score(target, data, offsets)[i] == pytest.approx(target.score(d1, o1)[0])
        assert model.score(data, offsets)[0][i] == pytest.approx(model.score(d1, o1)[0][0])
    assert (rules.gram_counts(data, offsets) == sum(rules.gram_counts(*list(text.slices(pa.array([t])))[0][2:]) for t in texts)).all()


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 4, 400)
    rows = [(np.array([5, 9, 11]), 8 * np.array([g / 3 + 0.15 * rng.normal(), 1 - g / 3 + 0.15 * rng.normal(), 0.5])) for g in grades]
    m = ordinal.fit(list(rows), grades, rounds=300)
    assert (np.diff(m.thresholds) > 0).all()
    score = np.array([(m.weights[i] * v).sum() for i, v in rows])
    tails = m.tails(score)
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    assert np.abs(tails.sum(1) - grades).mean() < 0.45


def test_ordinal_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    rated = spark.read.parquet(f"{LARGER}/labels.parquet")
    model = ordinal.train(docs, ordinal.graded(rated.where("doc_id % 2 = 0")))
    quality = {r.doc_id: r.quality for r in rated.where("doc_id % 2 = 1").collect()}
    got = [(quality[r.doc_id], r["__kept"]) for r in ordinal.assess(docs, model).collect() if r.doc_id in quality]
    assert np.mean([k for q, k in got if q]) > 0.98
    assert np.mean([not k for q, k in got if not q]) > 0.9


def test_ordinal_odd_rows(spark):
    docs = table(spark)
    model = ordinal.train(docs, spark.createDataFrame([(1, 0), (5, 2), (7, 1), (99, 1), (None, 2)], "doc_id long, grade int"))
    out = ordinal.assess(docs, model)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert len(rows) == len(ROWS)
    assert all(not r["___kept"] and r["__tail"] == 0 for r in rows if not WORDS.search(r.text or ""))
    assert ordinal.assess(table(spark, []), model).collect() == []
    kept = ordinal.select_good(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rated = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in rated.collect()}
    got = toxicity.score(docs.join(rated.select("doc_id"), "doc_id", "left_semi"), toxicity.train(docs, rated)).collect()
    held = [(toxic[r.doc_id], r.score >= toxicity.PREDICT) for r in got if r.held_out]
    assert len(held) > 500
    assert np.mean([p for t, p in held if t]) > 0.8
    assert np.mean([p for t, p in held if not t]) < 0.01


def test_toxicity_never_sees_the_held_out_fold(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rated = spark.read.parquet(f"{sf_dir}/labels.parquet")
    from pyspark.sql import functions as F

    turned = rated.withColumn("toxic", F.when(toxicity.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.score(docs, toxicity.train(docs, r)).collect())) for r in (rated, turned))
    assert a == b


def test_toxicity_odd_rows(spark):
    docs = table(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for rated in (none, spark.createDataFrame([(1, 0), (5, 1), (7, 0), (9, 1), (10, None)], "doc_id long, toxic int")):
        rows = toxicity.score(docs, toxicity.train(docs, rated)).collect()
        assert len(rows) == len(ROWS)
        assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(table(spark, []), toxicity.train(docs, none)).collect() == []


def test_isotonic_is_monotone_and_pools():
    rng = np.random.default_rng(4)
    s = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * s))).astype(float)
    xs, vs = toxicity.isotonic(s, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(vs) >= 0).all()
    assert vs.min() > 0 and vs.max() < 1


def test_disguised_insults():
    lex = toxicity.Lexicon(frozenset({"blargh"}), frozenset({"zork"}))
    assert lex.codes("Idiot!") & 1
    assert lex.codes("bl4rgh,") & 16
    assert lex.codes("m0r0n") & 16
    assert lex.codes("zorkable") & 4
    assert lex.codes("You") == 8
    assert lex.codes("table") == 0


def plain_features(t, lex):
    """FEATURES of a text, word by word."""
    words = [w for w in re.split(r"[ \t-\r]+", t) if w]
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    n, size = len(words), len(t.encode())
    insult, learned, stems, you, disguised = [], [], [], [], []
    for i, w in enumerate(words):
        parts = re.findall(r"[^\W\d_]+", w.lower())
        hit = any(p in toxicity.INSULTS for p in parts)
        own = any(p in lex.words for p in parts)
        insult += [i] * hit
        learned += [i] * own
        stems += [i] * any(p[:k] in lex.stems for p in parts for k in (3, 4, 5, 6))
        you += [i] * any(p in toxicity.SECOND_PERSON for p in parts)
        if not hit and not own:
            low = w.lower().strip(".,;:!?\"'()")
            for a, b in zip("013457@$!|*", "oieastasiil"):
                low = low.replace(a, b)
            plain = "".join(re.findall(r"[^\W\d_]+", low))
            if plain != w.lower() and plain in toxicity.INSULTS | lex.words and not w.lower().isalpha():
                disguised.append(i)
    bad = sorted({*insult, *learned, *stems, *disguised})
    near = sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in bad) if you else 0
    count = lambda chars: 100 * sum(c in chars for c in t) / size
    capitals = count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [len(insult), 100 * len(insult) / n, len(learned), 100 * len(learned) / n, len(stems), 100 * len(stems) / n, near, 100 * len(you) / n, len(disguised), capitals, count("!"), count("#*$%&|<>@^~"), count("0123456789"), np.log1p(n)]


def test_toxicity_features_against_a_plain_version():
    lex = toxicity.Lexicon(frozenset({"blargh", "snork"}), frozenset({"zork", "qua"}))
    texts = ["", "   ", "You IDIOT! you are a bl4rgh, m0r0n!!", "quant zorkable table 12 #*$ tu es stupid", "stupid " + "a " * 9 + "you", "é ü snork-you snork_x ~^|", "x" * 500, LONG_TEXT]
    codes = toxicity._Codes(lex)
    for t in texts:
        assert toxicity.text_features(t.encode(), codes) == pytest.approx(plain_features(t, lex)), t


LONG_TEXT = " ".join(("you", "idiot", "some", "plain", "words", "Blargh.", "7", "here")[(i * i + i // 7) % 8] for i in range(3000))


def test_trees_against_a_search_of_all_splits():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (120, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(120) < 0.1)).astype(float)
    model = toxicity.grow(x, y, trees=1, depth=1, rate=1.0)
    p = np.full(120, 1 / (1 + np.exp(-model["prior"])))
    g, h = y - p, p * (1 - p)

    def gain(f, c):
        left = x[:, f] <= c
        parts = [(g[m].sum(), h[m].sum()) for m in (left, ~left)]
        return sum(a * a / (b + 1) for a, b in parts) - g.sum() ** 2 / (h.sum() + 1)

    best = max(((f, c) for f in range(3) for c in range(5)), key=lambda s: gain(*s))
    feature, cut, value = model["trees"][0]
    assert (feature[0], cut[0]) == best
    left = x[:, feature[0]] <= cut[0]
    assert value == pytest.approx([g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])
    assert toxicity.margins(model, x) == pytest.approx(model["prior"] + np.where(left, *value))


def test_isotonic_against_least_squares_by_means():
    rng = np.random.default_rng(9)
    s, y = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60).astype(float)
    xs, vs = toxicity.isotonic(s, y)
    at = np.unique(s)
    n = np.array([(s == a).sum() for a in at])
    m = np.array([y[s == a].mean() for a in at])
    mean = lambda a, b: np.average(m[a : b + 1], weights=n[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    size = np.array([n[np.isclose(want, w)].sum() for w in want])
    smooth = (np.array(want) * size + 0.5 * y.mean()) / (size + 0.5)  # half an unlike label for each pool
    assert np.interp(at, xs, vs) == pytest.approx(np.maximum.accumulate(smooth))


def test_quality_ratio_against_a_plain_version(spark):
    target = rules.Target(np.random.default_rng(1).normal(size=1 << rules.BITS), 0.05)
    texts = [r[1] for r in ROWS] + ["abc", "abcd", "a longer text with ten words or more in it, so kept or not"]
    got = rules.judge(table(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), target).collect()
    for r in got:
        data = np.frombuffer((texts[r.doc_id] or "").encode(), np.uint8)
        grams = [int(rules.buckets(data[k : k + 4])[0]) for k in range(len(data) - 3)] if len(data) < 3000 else None
        if grams is not None:
            want = np.mean([target.ratio[b] for b in grams]) if grams else 0.0
            assert r.score == pytest.approx(want)
            assert r.kept == (not r.base_failed and want >= 0.05)


def test_ordinal_score_and_verdict_against_a_plain_version(spark):
    import pyarrow as pa

    from gridweave.llm import text

    model = ordinal.Model(np.random.default_rng(2).normal(size=ordinal.SIZE), np.array([-0.2, 0.4]))
    texts = [r[1] for r in ROWS]
    got = ordinal.assess(table(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), model).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        (_, _, data, offsets), = text.slices(pa.array([t]))
        families, n = ordinal.features(data, offsets)
        score = sum(scale * (model.weights[f[lo[0] : hi[0]]].sum() / max(1, hi[0] - lo[0])) for scale, (f, lo, hi) in zip(ordinal.SCALES, families))
        tails = [1 / (1 + np.exp(c - score)) if n[0] else 0.0 for c in model.thresholds]
        assert r["__expected"] == pytest.approx(sum(tails)) and r["__tail"] == pytest.approx(tails[0])
        assert r["___kept"] == (tails[0] >= 0.5)  # the table has a column __kept of its own
