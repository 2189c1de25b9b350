"""Ranked search, alignment and URL rules against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from llm import alignment as A
from llm import lexical_search as S
from llm import url_filter as U
from llm.shared import tokenizer

A_PATH, B_PATH = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def same(found, expected):
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, expected), key=str)


# --- Ranked search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain_rank(docs, items, k):
    split = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in split), sum(c.total() for _, c in split)
    df = Counter(t for _, c in split for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in split:
            m = 75 + 25 * c.total() * n_docs // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in plain_terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


ITEMS = [(1, "abc de ZZ zz"), (2, None), (3, "!!"), (4, "a a b é 日本語 one"), (5, "one Two"), (5, "one Two"), (None, "b"), (7, "unheard"), (8, "ab a"),
         (9, "klmno " * 40 + "abcde")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("first, shard, k, blocks", [(1, 3, 4, 100), (2, 8192, 20, 2), (128, 8192, 1, 100)])
def test_ranked_search(hard_docs, unique_docs, items, monkeypatch, first, shard, k, blocks):
    monkeypatch.setattr(S, "FIRST_READ", first)
    monkeypatch.setattr(S, "SHARD", shard)
    for docs in (hard_docs, unique_docs):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        draw = random.Random(k)
        more = [(100 + i, " ".join(draw.choices(plain_terms(draw.choice(rows)[1]) or ["x"], k=12))) for i in range(8)]
        asked = docs.sparkSession.createDataFrame(ITEMS + more, "item_id long, text string")
        same(S.rank(docs, asked, k, block_items=blocks).collect(), plain_rank(rows, ITEMS + more, k))


def test_ranked_search_of_empty_tables(hard_docs, items):
    assert S.rank(hard_docs.limit(0), items).collect() == []
    assert S.rank(hard_docs, items.limit(0)).collect() == []
    assert S.rank(hard_docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_nra_ends_early_and_is_exact():
    draw = np.random.default_rng(4)
    for trial in range(60):
        docs, vocabulary = 300, 6
        doc = np.concatenate([np.sort(draw.choice(docs, draw.integers(1, docs), replace=False)) for _ in range(vocabulary)])
        sizes = np.cumsum([0, *np.flatnonzero(np.diff(doc) < 0) + 1 - np.append(0, np.flatnonzero(np.diff(doc) < 0) + 1)[:-1]])
        term = np.zeros(len(doc), np.int64)
        term[sizes[1:][sizes[1:] < len(doc)]] = 1
        term = np.cumsum(term)
        impact = draw.integers(1, 4 if trial % 2 else 10**6, len(doc))
        shard = S.Shard(doc, term, impact, docs, vocabulary)
        wanted, repeats = np.arange(vocabulary), draw.integers(1, 3, vocabulary)
        exact = np.zeros(docs, np.int64)
        np.add.at(exact, doc, impact * repeats[term])
        floor = int(np.sort(exact)[-5]) if trial % 3 == 0 else 0
        found, score = shard.search(wanted, repeats, 7, floor)
        assert (exact[found] == score).all()
        least = max(np.sort(exact)[-7], floor, 1)
        assert set(found[score >= least]) == set(np.flatnonzero(exact >= least))


# --- Alignment ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B_PATH)


def plain_alignment(docs, libraries):
    a, b = libraries
    entries = {c: i for i, c in enumerate(byte_chars())}
    aligned, counts = [], Counter()
    for doc, text in docs:
        whole = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(entries[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            aligned.append((doc, [], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        links = [(x, y) for x, (s, e) in zip(ids_a, zip([0, *ends[0]], ends[0])) for y, (t, f) in zip(ids_b, zip([0, *ends[1]], ends[1])) if s < f and t < e]
        counts.update(links)
        cuts, parts = sorted(set(ends[0]) & set(ends[1])), []
        for start, end in zip([0, *cuts], cuts):
            parts.append("|".join(",".join(str(i) for i, e in zip(ids, of) if start < e <= end) for ids, of in zip((ids_a, ids_b), ends)))
        aligned.append((doc, ids_a, ids_b, parts, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(doc, len(x), len(y), len(parts), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "") for doc, x, y, parts, links in aligned]


def byte_chars():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(others)) for b in range(256)]


ODD = ["a  b   c", "x\n \ny", " lead", "trail ", "a ▁ b", "<s> <unk> </s> <0x41> <|endoftext|>", "\u3000wide\u2003gap", "it's we'll 12 345,67", "é e\u0301 ﬁ ½",
       "🙂🙂 🇫🇷", "\x00\x01 \x1c\x1d", "\r\n\r\n a", "a\tb\t c", "▁", "   ", "日本語テキスト mixed", "x" * 300 + " " + "y" * 300]


@pytest.mark.parametrize("chunk, table, together", [(1 << 24, 400_000, 4096), (200, 5, 3)])
def test_alignment(spark, hard_docs, libraries, monkeypatch, chunk, table, together):
    monkeypatch.setattr(A, "SLICE", chunk // 4)
    monkeypatch.setattr(A, "STRETCHES", table)
    monkeypatch.setattr(A, "TOGETHER", together)
    odd = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = hard_docs.select("doc_id", "text").where("length(text) < 4000 or text is null").unionByName(odd)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = plain_alignment(rows, libraries)
    assert sum(bool(r[1]) for r in expected) > 20
    same(A.alignments(docs, A_PATH, B_PATH, chunk).collect(), expected)
    assert A.alignments(hard_docs.limit(0), A_PATH, B_PATH).collect() == []


def test_stretches_are_whole_texts(libraries, monkeypatch):
    """Ids put together from stretches are those of the whole text, also for mixtures of odd characters."""
    a, b = libraries
    assert A.splits(A_PATH, B_PATH)
    draw = random.Random(6)
    letters = ["a", "B", "é", "日", " ", " ", " ", "  ", "\n", "\t", "'s", "9", ".", "▁", "\u00a0", "\x1c", "🙂", "the", "\u3000", "\x85"]
    texts = ["".join(draw.choices(letters, k=draw.randint(1, 40))) for _ in range(3000)]
    table = A.Stretches((A_PATH, B_PATH))
    cut = [table.cut(t) for t in texts]
    long = table.meet(cut)
    for text, parts in zip(texts, cut):
        found = [table.get(p) or long[p] for p in parts]
        assert np.frombuffer(b"".join(f[0] for f in found), "<u4").tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(f[1] for f in found), "<u4").tolist() == b.encode(text)


# --- URL rules ----------------------------------------------------------------------------

RULES = [("com", "/", "allow"), ("Example.COM", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("b.net", None, "allow"), ("b.net", "", "block"), ("org", "/é", "block"), ("a.org", "/", "allow"), ("", "/", "block"),
         (None, "/", "block"), ("x.net", "no", "block"), ("y.net", "/", "odd"), ("q/r", "", "block"), ("net", "/es/fr", "allow")]
URLS = [None, "", "no scheme/en/", "http://", "http://com", "http://com/", "http://COM/x", "https://Example.com/en/a?b#c", "x://www.EXAMPLE.com/en/",
        "http://wwwexample.com/en/", "http://a.b.net", "http://b.net?x", "http://ab.net/es/1", "http://net/es/fr/2", "http://net#/es/", "://org/éa",
        "http://a.org/éa", "http://z.a.org/e", "http://u://v.com/", "http://..com/", "http://com./", "http://" + "a." * 3000 + "com/" + "p" * 5000,
        "http://ÀB.com/", "http://x.com:80/", "http://user@x.com/", "http://q/r", "//com/"]


def plain_verdict(url):
    _, mark, rest = (url or "").partition("://")
    host = re.match("[^/?#]*", rest if mark else "").group()
    path = re.match("[^?#]*", rest[len(host):] if mark else "").group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best, verdict = "", "allow"
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and "/" not in h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p):
            if len(h + p) > len(best) or (h + p == best and v == "block"):
                best, verdict = h + p, v
    return host, path, best or None, verdict


@pytest.mark.parametrize("block, probes", [(500_000, 200_000), (2, 3)])
def test_url_rules(spark, monkeypatch, block, probes):
    monkeypatch.setattr(U, "PROBES", probes)
    urls = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(URLS)] + [(3, "http://com/", "again", None)], "page_id long, url string, rule string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = U.judge(urls, rules, block_rules=block).collect()
    same([(r.row.url, r.host, r.path, r.rule, r.verdict) for r in found], [(u, *plain_verdict(u)) for u in [*URLS, "http://com/"]])
    assert {tuple(r.row)[2] for r in found} == {"r", "again"}
    kept = U.allowed(urls, rules)
    assert kept.columns == urls.columns and kept.count() == sum(r.verdict == "allow" for r in found)


def test_url_rules_of_empty_tables(spark):
    rules = U.rule_table(spark)
    urls = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    assert U.verdicts(urls.limit(0), rules).collect() == []
    assert [tuple(r) for r in U.verdicts(urls, rules.limit(0)).collect()] == [(1, "a.net", "/es/", None, "allow")]
    assert U.judge(urls, rules.limit(0), default="block").first().verdict == "block"


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(U, "xxh64_intdigest", lambda text, seed: len(text))
    rows = [{"key": k, "host_chars": len(k), "path_chars": 0, "blocked": i % 2} for i, k in enumerate(["ab", "cd", "ef", "long"])]
    (tmp_path / "rules").write_bytes(U._image(rows))
    array = U.DigestArray(str(tmp_path / "rules"))
    texts = [b"cd", b"xy", b"ef", b"lone", b"long", b"z"]
    probes, places = array.find(np.array([len(t) for t in texts], np.uint64), texts)
    assert probes.tolist() == [0, 2, 4] and [int(array.flags[p]) & 1 for p in places] == [1, 0, 1]
