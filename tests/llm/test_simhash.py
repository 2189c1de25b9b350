import random
import re
from itertools import combinations

import pytest
import xxhash

from llm.components import components
from llm.simhash import keep_one, links, near_duplicates


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, pairs):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_equals_brute_force(hard_docs):
    rows = hard_docs.select("doc_id", "text").collect()
    prints = {(r.doc_id, r.text): fingerprint(r.text) for r in rows}
    root = roots(set(prints.values()), [(a, b) for a, b in combinations(set(prints.values()), 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for (doc, _), p in prints.items():
        least[root[p]] = min(x for x in (doc, least.get(root[p]), 1 << 62) if x is not None)
    expected = sorted(((r.doc_id, f"{prints[r.doc_id, r.text]:016x}", least[root[prints[r.doc_id, r.text]]]) for r in rows), key=str)
    found = [tuple(r) for r in near_duplicates(hard_docs).collect()]
    assert sorted(((a, b, 1 << 62 if c is None else c) for a, b, c in found), key=str) == expected
    assert near_duplicates(hard_docs.limit(0)).collect() == []


def test_one_of_each_group_stays(hard_docs):
    kept = keep_one(hard_docs)
    assert kept.columns == hard_docs.columns
    rows = kept.collect()
    found = near_duplicates(hard_docs).collect()
    prints = {int(r.fingerprint, 16) for r in found}
    root = roots(prints, [(a, b) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2])
    least = {root[int(r.fingerprint, 16)]: r.component_id for r in found}
    assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, least.values()))
    assert {root[fingerprint(r.text)] for r in rows} == set(least)
    twice = hard_docs.unionByName(hard_docs)
    assert sorted(map(tuple, keep_one(twice).collect()), key=str) == sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("crowd", [0, 5, 10_000])
def test_no_link_is_lost(spark, crowd):
    draw = random.Random(9)
    values = {draw.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 3))))
    near = [(signed(a), signed(b)) for a, b in combinations(values, 2) if (a ^ b).bit_count() <= 2]
    frame = spark.createDataFrame([(signed(v),) for v in values], "print long")
    found = links(frame, crowd).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found)
    every = {signed(v) for v in values}
    assert roots(every, [(r.a, r.b) for r in found]) == roots(every, near)


def test_components_of_chains_stars_and_rings(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.root for r in components(frame).collect()}
    assert found == roots({x for p in pairs for x in p}, pairs)
    assert components(frame.limit(0)).collect() == []
