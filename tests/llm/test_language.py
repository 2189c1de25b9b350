import math
from collections import Counter

import numpy as np
import pytest

from llm import language as L
from llm.shared import tokenizer

PATH = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return L.pieces(PATH)


def every_segmentation(marked, vocabulary, chance, unknown):
    """Sum over all ways to cut the word into pieces, each cut tried."""
    if not marked:
        return 1.0
    total = 0.0
    for n in range(1, min(L.PIECE, len(marked)) + 1):
        piece = vocabulary.get(marked[:n], unknown if n == 1 else 0)
        if piece:
            total += chance[piece] * every_segmentation(marked[n:], vocabulary, chance, unknown)
    return total


def test_lattice_equals_lookups(vocabulary):
    words = ["hello", "w", "ñandú", "日本", "welthello", "uebermorgen"]
    found = L.lattice(words, vocabulary)
    for word, rows in zip(words, found, strict=True):
        marked = "▁" + word
        for end in range(1, rows.shape[0] + 1):
            for n in range(1, L.PIECE + 1):
                expected = -1 if end > len(marked) else vocabulary.get(marked[end - n:end], 0) if n <= end else 0
                assert rows[end - 1, n - 1] == (len(vocabulary) + 1 if expected == 0 and n == 1 else expected)


def test_forward_sums_all_segmentations(vocabulary):
    model = L.learn({"a": Counter({"hello": 3, "world": 1}), "b": Counter({"hallo": 2, "welt": 5})}, vocabulary)
    words = ["hello", "w", "ñandú", "日本", "welthello"]
    found = model.scores(words, vocabulary)
    for word, row in zip(words, found, strict=True):
        for k in range(2):
            expected = every_segmentation("▁" + word, vocabulary, model.chance[:, k], len(vocabulary) + 1)
            assert math.isclose(row[k], math.log(expected), rel_tol=1e-9)


def test_learning_raises_the_likelihood(vocabulary, monkeypatch):
    words = Counter({"thation": 9, "ingthe": 4, "renation": 7, "the": 30})

    def likelihood(rounds):
        monkeypatch.setattr(L, "ROUNDS", rounds)
        monkeypatch.setattr(L, "PRIOR", 1e-6)
        model = L.learn({"x": words}, vocabulary)
        return sum(n * s for n, s in zip(words.values(), model.scores(list(words), vocabulary)[:, 0], strict=True))

    assert likelihood(1) < likelihood(2) < likelihood(4)
    model = L.learn({"x": words}, vocabulary)
    assert np.allclose(model.chance.sum(axis=0), 1)


def test_held_out_accuracy_and_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id: r for r in L.predict(docs, PATH).collect()}
    rows = docs.collect()
    held = [r for r in rows if found[r.doc_id].held_out]
    assert len(held) > 20
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    model = L.fit(docs, PATH)
    plain = docs.select("doc_id", "text")
    a = {r.row.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, model, PATH).collect()}
    b = {r.row.doc_id: (r.lang_pred, r.score) for r in L.identify(plain, model, PATH, ["doc_id"]).collect()}
    assert a == b


def test_hard_rows(hard_docs):
    found = L.predict(hard_docs, PATH).collect()
    texts = Counter((r.doc_id, "und" if not any(c.isalpha() for c in r.text or "") else "en") for r in hard_docs.collect())
    assert Counter((r.doc_id, r.lang_pred) for r in found) == texts
    assert all(0 <= r.score <= 1 for r in found)
    assert L.predict(hard_docs.limit(0), PATH).collect() == []
    unlabelled = hard_docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in L.predict(unlabelled, PATH).collect()} == {"und"}


def test_full_tables_change_nothing(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    model = L.fit(docs, PATH)
    one = sorted((r.row.doc_id, r.lang_pred) for r in L.identify(docs, model, PATH, ["doc_id"]).collect())
    scores = L._Scores(model, PATH)
    monkeypatch.setattr(L, "CACHE", 3)
    for doc, lang in one:
        text = docs.where(f"doc_id = {doc}").first().text
        words = L.words_of(text)
        scores.meet(set(words))
        total = scores.table[[scores[w] for w in words]].sum(axis=0)
        assert model.langs[total.argmax()] == lang
