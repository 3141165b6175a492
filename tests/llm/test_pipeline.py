from collections import Counter

import corpus_pipeline
from gridweave.llm import common, exact, mixing, ordinal, simhash
from tests.llm.test_exact_and_mixing import brute_exact
from tests.llm.test_near_and_substrings import brute_components, brute_fingerprint
from tests.llm.test_packing import check


def test_stages_against_brute_force(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    names = docs.columns
    functions = dict(corpus_pipeline.STAGES)

    kept = common.materialize(functions["quality_classifier"](spark, docs, sf_dir))
    assert kept.columns == names
    model = ordinal.train(docs, ordinal.graded(common.labels(spark, sf_dir)))
    good = {r.doc_id for r in ordinal.assess(docs, model).where("__kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and 0 < len(good) < docs.count()

    rows = [(r.doc_id, r.text) for r in kept.collect()]
    once = common.materialize(functions["exact_dedup"](spark, kept, sf_dir))
    assert once.columns == names
    assert {r.doc_id for r in once.collect()} == {i for i, _, _, stays, _ in brute_exact(rows) if stays}

    rows = [(r.doc_id, r.text) for r in once.collect()]
    first = common.materialize(functions["simhash_near_dedup"](spark, once, sf_dir))
    assert first.columns == names
    comp = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    assert {r.doc_id for r in first.collect()} == set(comp)

    mixed = common.materialize(functions["source_mixing"](spark, first, sf_dir))
    assert mixed.columns == names
    taken = {r.doc_id: r["__taken"] for r in mixing.mix(first).collect()}
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len((r.text or "").split())
    assert got == Counter({i: n for i, n in taken.items() if n})

    packed = functions["best_fit_packing"](spark, mixed, sf_dir)
    check(packed.collect(), [(r.doc_id, r.text) for r in mixed.collect()], 4096)
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_stages_call_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    assert exact and simhash
