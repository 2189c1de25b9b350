import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm import pretokens
from llm.packing import BestFit, pack
from llm.shared import tokenizer
from llm.token_counts import token_counts

PATH = tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts_equal_the_library(hard_docs, library):
    found = token_counts(hard_docs, PATH).collect()
    expected = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids))
                       for r in hard_docs.collect()), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=str) == expected
    assert all(r.over_limit == (r.n_tokens > 2048) for r in found)
    assert token_counts(hard_docs.limit(0), PATH).collect() == []


def test_whole_tokens_are_proven(library):
    whole = pretokens.whole_tokens(PATH)
    assert len(whole) > 10_000
    for text in random.Random(1).sample(sorted(whole), 300):
        assert library.encode(text, add_special_tokens=False).ids == [whole[text]]


def test_full_tables_change_nothing(monkeypatch, library):
    monkeypatch.setattr(pretokens, "CACHE", 5)
    table = pretokens.Words(PATH)
    texts = ["the Cat sat, on the mat's edge " * 3, "unbelievable xqzzyk <|endoftext|> naïve 日本", "the cat " * 5]
    for text in texts * 3:
        chunks = pretokens.chunks(text)
        table.meet([chunks])
        ids = np.frombuffer(b"".join(map(table.__getitem__, chunks)), "<u4").tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids


def test_packing(hard_docs, library):
    found = pack(hard_docs, PATH).collect()
    expected = []
    for r in hard_docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(r.doc_id, k, k * 4096, len(p), zlib.crc32(p.tobytes())) for k in range(-(-len(ids) // 4096))
                     for p in [ids[4096 * k:4096 * k + 4096]]]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(expected, key=str)
    bins: dict = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
        assert sum(n for _, n in placed) <= 4096
    assert len(bins) <= -(-sum(r.length for r in found) // 4096) + 1
    assert pack(hard_docs.limit(0), PATH).collect() == []


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    packer = BestFit(10, bins=2)
    assert [packer.put(n) for n in (7, 5)] == [(0, 0), (1, 0)]
    assert packer.put(3) == (0, 7)
    assert packer.put(8) == (2, 0)
    assert packer.put(6) == (3, 0)  # bin 2, the fuller of the open ones, closes
    assert packer.put(2) == (3, 6)
    assert packer.put(5) == (1, 5)


def test_best_fit_against_a_plain_search():
    draw = random.Random(8)
    packer, free, made = BestFit(64, bins=6), {}, 0
    for _ in range(2000):
        size = draw.randint(1, 64)
        fit = min((f for f in free.values() if f >= size), default=None)
        at, offset = packer.put(size)
        if fit is not None:
            assert free[at] == fit and offset == 64 - fit
        else:
            assert at == made and offset == 0
            made += 1
            if len(free) >= 6:
                tight = min(free.values())
                gone = next(b for b in packer_closed(free, tight, packer))
                del free[gone]
            free[at] = 64
        free[at] -= size
        if not free[at]:
            del free[at]


def packer_closed(free, tight, packer):
    """Bins of the least free space that the packer no longer has open."""
    still = {b for bins in packer.at for b in bins}
    return [b for b, f in free.items() if f == tight and b not in still]
