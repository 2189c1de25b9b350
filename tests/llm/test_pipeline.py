import re

import corpus_pipeline as P
from tests_llm_brute import brute_decontaminated, brute_kept, brute_trimmed

from llm.shared import stored, table


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    items = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    seen = {}
    for name, stage in P.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf))
        seen[name] = docs
        if name != P.STAGES[-1][0]:
            assert docs.columns == before.columns
        rows = {r.doc_id: r for r in before.collect()} if name != P.STAGES[-1][0] else {}
        after = {r.doc_id: r for r in docs.collect()}
        if name == "language_id":
            assert set(after) == {i for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")}
        elif name == "simhash_near_dedup":
            assert set(after) == brute_kept({i: r.text for i, r in rows.items()})
        elif name == "substring_dedup":
            assert {i: r.text for i, r in after.items()} == brute_trimmed({i: r.text for i, r in rows.items()})
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "benchmark_decontamination":
            assert set(after) == brute_decontaminated({i: r.text for i, r in rows.items()}, items)
    pieces = seen["best_fit_packing"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in seen["benchmark_decontamination"].collect()}
    whole = P.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, pieces))


def test_hard_rows_pass_every_stage(spark, hard_docs, sf):
    docs = hard_docs
    for _, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf))
        assert docs.columns == hard_docs.columns
    assert P.STAGES[-1][1](spark, docs, sf).count() >= docs.count()
    empty = stored(hard_docs.limit(0))
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
