import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm import automaton, repeats, run_index
from llm.automaton import SuffixAutomaton
from llm.run_index import RunIndex
from llm.windows import contexts


def _cut(tokens, gone):
    return [t for t, g in zip(tokens, gone, strict=True) if not g]


def brute_bytes(texts, size=run_index.SIZE):
    raws = [t.encode() for t in texts]
    seen = Counter(r[i:i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - size + 1):
            if seen[raw[i:i + size]] > 1:
                gone[i:i + size] = True
        kept = bytes(_cut(raw, gone))
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, size=automaton.SIZE):
    seen, out = set(), []
    for text in texts:
        words = text.encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - size + 1):
            window = tuple(words[i:i + size])
            if window in seen:
                gone[i:i + size] = True
            seen.add(window)
        out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(_cut(words, gone))).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 1000])
@pytest.mark.parametrize(("module", "brute"), [(run_index, brute_bytes), (automaton, brute_words)])
def test_equals_brute_force(monkeypatch, unique_docs, module, brute, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    found = {r[0]: tuple(r)[1:] for r in module.digests(module.remove_repeats(unique_docs)).collect()}
    rows = sorted(unique_docs.collect())
    expected = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows]), strict=True))
    assert found == expected
    assert sum(x[1] for x in expected.values()) > 1000


@pytest.mark.parametrize("module", [run_index, automaton])
def test_hard_rows_and_empty_tables(hard_docs, module):
    done = module.remove_repeats(hard_docs)
    rows = module.digests(done).collect()
    assert len(rows) == hard_docs.count()
    assert all(r[1] == 0 for r in rows if r.doc_id == 0)
    kept = done.select("row.row", "row.kept", "row.lang").collect()
    assert {r.row for r in kept} == {r.row for r in hard_docs.collect()}
    assert module.digests(module.remove_repeats(hard_docs.limit(0))).collect() == []


def brute_rows(rows, size=automaton.SIZE):
    """(doc_id, words, removed words, hash of the rest) of rows with null and repeated ids: earlier is a smaller id, or a start before in the row."""
    order = lambda r: float("inf") if r.doc_id is None else r.doc_id
    least, out = {}, []
    split = [(r.text or "").encode().split() for r in rows]
    for r, words in zip(rows, split, strict=True):
        for i in range(len(words) - size + 1):
            window = tuple(words[i:i + size])
            least[window] = min(least.get(window, order(r)), order(r))
    for r, words in zip(rows, split, strict=True):
        gone, seen = np.zeros(len(words), bool), set()
        for i in range(len(words) - size + 1):
            window = tuple(words[i:i + size])
            if window in seen or least[window] < order(r):
                gone[i:i + size] = True
            seen.add(window)
        out.append((r.doc_id, len(words), int(gone.sum()), hashlib.sha256(b" ".join(_cut(words, gone))).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [1, 1000])
def test_repeated_rows_keep_what_no_earlier_document_has(monkeypatch, hard_docs, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    for docs in (hard_docs, hard_docs.unionByName(hard_docs)):
        found = sorted((tuple(r) for r in automaton.digests(automaton.remove_repeats(docs)).collect()), key=str)
        assert found == brute_rows(docs.select("doc_id", "text").collect())


@pytest.mark.parametrize("crowd", [1, 1000])
def test_repeated_bytes_of_repeated_rows(monkeypatch, hard_docs, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = hard_docs.select("doc_id", "text").collect()
    found = sorted((tuple(r) for r in run_index.digests(run_index.remove_repeats(hard_docs)).collect()), key=str)
    expected = zip([r.doc_id for r in rows], brute_bytes([r.text or "" for r in rows]), strict=True)
    assert found == sorted(((i, *x) for i, x in expected), key=str)


def test_copies(spark):
    text = " ".join(f"word{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text + " more"), (None, text), (4, text), (4, text)], "doc_id long, text string")
    words = sorted((r.doc_id or 99, r.n_removed) for r in automaton.digests(automaton.remove_repeats(docs)).collect())
    assert words == [(1, 0), (2, 100), (3, 100), (4, 100), (4, 100), (99, 100)]
    size = len(text)
    found = sorted((r.doc_id or 99, r.n_removed) for r in run_index.digests(run_index.remove_repeats(docs)).collect())
    assert found == [(1, size), (2, size), (3, size), (4, size), (4, size), (99, size)]


def test_clean_texts_stay_as_they_are(spark):
    docs = spark.createDataFrame([(1, "a  b\nc")], "doc_id long, text string")
    assert automaton.remove_repeats(docs, tidy=False).first().kept == "a  b\nc"
    assert automaton.remove_repeats(docs).first().kept == "a b c"


def test_run_index_statistics():
    draw = random.Random(1)
    base = [draw.randrange(4) for _ in range(60)]
    texts = []
    for _ in range(12):
        text = list(base)
        text[draw.randrange(60)] = draw.randrange(4)
        texts.append(np.array(text[:draw.randint(1, 60)], np.uint8))
    texts += [texts[0], np.array([], np.uint8)]
    index = RunIndex(texts)
    found = index.statistics()
    raws = [bytes(t) for t in texts]
    for i, raw in enumerate(raws):
        for p in range(len(raw)):
            longest = 0
            for j, other in enumerate(raws):
                for q in range(len(other)):
                    if (i, p) != (j, q):
                        n = 0
                        while p + n < len(raw) and q + n < len(other) and raw[p + n] == other[q + n]:
                            n += 1
                        longest = max(longest, n)
            assert found[index.starts[i] + p] == longest
    assert index.runs < index.length


def test_automaton_matches():
    draw = random.Random(2)
    texts = [[draw.randrange(3) for _ in range(draw.randint(0, 25))] for _ in range(20)]
    machine = SuffixAutomaton()
    for k, text in enumerate(texts):
        known = {tuple(t[a:b]) for t in texts[:k] for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
        expected = [max((n for n in range(1, i + 2) if tuple(text[i + 1 - n:i + 1]) in known), default=0) for i in range(len(text))]
        assert machine.matches(text) == expected
        machine.add(text)


def test_every_window_is_in_one_context_and_anchors_depend_on_content(monkeypatch):
    from llm import windows

    draw = np.random.default_rng(4)
    text = draw.integers(0, 5, 900).astype(np.uint64)
    whole = contexts(np.concatenate([text, text]), 40, 11)
    assert whole[2][0] == 0
    assert (whole[2][1:] == whole[3][:-1] + 1).all()
    assert whole[3][-1] == 1800 - 40
    at = {}
    for anchor, first, last in zip(whole[0], whole[2], whole[3], strict=True):
        for s in range(first, last + 1):
            at[s] = anchor
    assert all(at[s] == at[s + 900] for s in range(900 - 39))
    monkeypatch.setattr(windows, "SEGMENT", 128)
    parts = contexts(np.concatenate([text, text]), 40, 11)
    assert sorted(s for a, b in zip(parts[2], parts[3], strict=True) for s in range(a, b + 1)) == list(range(1800 - 39))
