import hashlib
from collections import defaultdict

import xxhash

from llm import order_minhash as M
from llm.order_minhash import fingerprint_edits


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def h(*values):
    """Hash of longs or of one string, each seeded by the hash before."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return signed(seed)


def fingerprint(text):
    words = [w for w in text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    codes = [h(w) for w in words]
    grams = [h(*codes[i:i + 3]) for i in range(max(1, len(codes) - 2))] if codes else []
    seen, tuples = defaultdict(int), defaultdict(list)
    for position, gram in enumerate(grams):
        top = gram >> 24
        value = top if not seen[top] else signed(xxhash.xxh64_intdigest(seen[top].to_bytes(4, "little"), h(top) & (1 << 64) - 1)) >> 24
        seen[top] += 1
        tuples[(value >> 34) & 63].append((value, position))
    out = []
    for t in sorted(tuples):
        least = sorted(tuples[t])[:2]
        ordered = [v for v, _ in sorted(least, key=lambda x: x[1])]
        out.append(t << 32 | (h(*ordered) & (1 << 64) - 1) >> 32)
    return out


def likeness(a, b):
    tuples = {x >> 32 for x in a} | {x >> 32 for x in b}
    return (len(set(a) & set(b)) / len(tuples)) ** (1 / M.TUPLE) if tuples else 1.0


def test_equals_brute_force(unique_docs):
    rows = sorted(unique_docs.collect(), reverse=True)
    found = {r.doc_id: r for r in fingerprint_edits(unique_docs).collect()}
    assert len(found) == len(rows)
    for i, row in enumerate(rows):
        after = rows[(i + 1) % len(rows)].text
        half = len(row.text) // 2
        edited = row.text[:len(row.text) - half] + after[:half]
        own, other = fingerprint(row.text), fingerprint(edited)
        r = found[row.doc_id]
        assert r.n_chars == len(row.text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{x:010x}" for x in own)
        assert r.edited_fingerprint == "".join(f"{x:010x}" for x in other)
        assert abs(r.near_edited - likeness(own, other)) < 1e-9
        assert abs(r.near_next - likeness(own, fingerprint(after))) < 1e-9


def test_few_kept_kmers_fall_back_to_all(unique_docs, monkeypatch):
    before = sorted(map(tuple, fingerprint_edits(unique_docs).collect()))
    monkeypatch.setattr(M, "KEPT", 1)
    assert sorted(map(tuple, fingerprint_edits(unique_docs).collect())) == before


def test_hard_rows(hard_docs, spark):
    found = fingerprint_edits(hard_docs).collect()
    assert len(found) == hard_docs.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    alone = fingerprint_edits(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()
    assert fingerprint_edits(hard_docs.limit(0)).collect() == []


def test_order_of_words_counts(spark):
    words = [f"word{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    texts = [" ".join(words), " ".join(moved), " ".join(words[:390] + ["x"] * 10)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {r.doc_id: fingerprint(texts[r.doc_id]) for r in frame.collect()}
    assert likeness(prints[0], prints[2]) > likeness(prints[0], prints[1]) + 0.1
