import hashlib
import re

import pytest

from llm import decontaminate
from llm.decontaminate import decontaminate as run
from llm.decontaminate import without_hits

ITEMS = [
    (1, " ".join(f"w{i}" for i in range(14))), (2, "Short item here"), (3, " ".join(f"w{i}" for i in range(14))), (4, None), (5, "..."),
    (None, "one two three four five six seven eight nine ten eleven"), (6, "solo"), (7, "r " * 30), (10, " ".join(f"q{i % 4}" for i in range(25))),
]


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows: dict = {}
    for item, text in items:
        own = words(text)
        n = min(10, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            windows.setdefault((n, tuple(own[i:i + n])), set()).add(item)
    out = []
    for doc, text in docs:
        own, hit, found = words(text), set(), set()
        for n in {k[0] for k in windows}:
            for i in range(len(own) - n + 1):
                if met := windows.get((n, tuple(own[i:i + n]))):
                    hit |= set(range(i, i + n))
                    found |= met
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [3, 200_000])
def test_equals_brute_force(spark, hard_docs, monkeypatch, limit):
    monkeypatch.setattr(decontaminate.hits, "__defaults__", (limit,))
    run_of = " ".join(f"W{i}," for i in range(14))
    extra = [(100, f"x {run_of} y short-item HERE"), (101, " ".join(f"w{i}" for i in range(9))), (102, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 z w4 w5 w6 w7 w8 w9 w10 w11 w12 w13"),
             (103, "r " * 12), (104, "one two three four five six seven eight nine ten"), (105, "a solo b"), (106, " ".join(f"q{i % 4}" for i in range(60))), (107, run_of), (107, run_of)]
    docs = hard_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, words string")
    expected = brute([tuple(r) for r in docs.collect()], ITEMS)
    assert sorted((tuple(r) for r in run(docs, items).collect()), key=str) == expected
    left = sorted((tuple(r) for r in without_hits(docs, items).collect()), key=str)
    dirty = {r[0] for r in expected if r[5]}
    assert left == sorted((tuple(r) for r in docs.collect() if r[0] not in dirty), key=str)


def test_empty_tables_and_clashing_columns(spark, hard_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    found = run(hard_docs, items).collect()
    assert len(found) == hard_docs.count() and not any(r.contaminated for r in found)
    assert without_hits(hard_docs, items).columns == hard_docs.columns
    assert run(hard_docs.limit(0), items).collect() == []
