"""Substring dedup by suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.repeats import RUNS, Method, covered, keyed, repeated_windows, runs, with_starts
from llm.shared import held

#: Words of a repeated window.
SIZE = 20
#: Words of an anchor's k-gram.
GRAM = 8
#: Words that one automaton takes before it is begun anew, about; an anchor's contexts stay together.
STATES = 50_000
#: Word hashes that a worker keeps.
CACHE = 400_000


class SuffixAutomaton:
    """Automaton of all substrings of the texts added so far."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]

    def matches(self, text: list[int]) -> list[int]:
        """For each position, the longest match that ends there (matching statistics)."""
        following, link, longest = self.next, self.link, self.longest
        state = length = 0
        out = []
        for symbol in text:
            while state and symbol not in following[state]:
                state = link[state]
                length = longest[state]
            if symbol in following[state]:
                state = following[state][symbol]
                length += 1
            out.append(length)
        return out

    def add(self, text: list[int]) -> None:
        last = 0
        for symbol in text:
            last = self._extend(last, symbol)

    def _extend(self, last: int, symbol: int) -> int:
        following, link, longest = self.next, self.link, self.longest
        known = following[last].get(symbol)
        if known is not None:
            return known if longest[known] == longest[last] + 1 else self._split(last, symbol, known)
        new = len(link)
        following.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        state = last
        while state >= 0 and symbol not in following[state]:
            following[state][symbol] = new
            state = link[state]
        if state >= 0:
            known = following[state][symbol]
            link[new] = known if longest[known] == longest[state] + 1 else self._split(state, symbol, known)
        return new

    def _split(self, state: int, symbol: int, known: int) -> int:
        """A copy of ``known`` for the substrings that are one longer than those of ``state``."""
        following, link, longest = self.next, self.link, self.longest
        copy = len(link)
        following.append(dict(following[known]))
        link.append(link[known])
        longest.append(longest[state] + 1)
        link[known] = copy
        while state >= 0 and following[state].get(symbol) == known:
            following[state][symbol] = copy
            state = link[state]
        return copy


def _mark(weights: list[int], texts: list[np.ndarray], anchors: list[int]) -> list[np.ndarray]:
    """Windows that an earlier context has: each context is streamed, then added. Contexts come in order."""
    reference, out, last = SuffixAutomaton(), [], None
    for text, anchor in zip(texts, anchors, strict=True):
        if anchor != last and len(reference.link) > 2 * STATES:
            reference = SuffixAutomaton()
        words = text.tolist()
        out.append(np.array(reference.matches(words)[SIZE - 1:]) >= SIZE)
        reference.add(words)
        last = anchor
    return out


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= CACHE:
            self.clear()
        found = self[word] = xxh64_intdigest(word)
        return found


def _hashes() -> _Hashes:
    return held("hashes", _Hashes)


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words, which ASCII white space parts."""
    words = text.split()
    return np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))


def _compact(text: bytes) -> np.ndarray:
    return (tokens(text) >> np.uint64(32)).astype(np.uint32)


METHOD = Method(tokens=tokens, compact=_compact, kind="u4", size=SIZE, k=GRAM, ordered=True, index=_mark, levels=(1,))


def remove_repeats(docs: DataFrame, tidy: bool = True) -> DataFrame:
    """row, n_words, removed, kept for every row of ``docs`` (doc_id, text).

    ``row`` has the input's columns without text, ``removed`` the maximal removed runs (start, end) in
    words, ``kept`` the words that remain, unchanged and joined by one space; without ``tidy``, a text that
    loses nothing is left as it is. A word goes if a window of
    SIZE words that covers it also starts earlier: in a document of smaller id, or before it in its own.
    Removal looks at the input alone.

    The reference is every earlier text, cut into shards: candidates are routed to suffix automata of bounded
    size (``llm.repeats``), and each shard's contexts are streamed through its automaton in order. Equal
    contexts are settled by counting before that. Text is shuffled once, by document.

    Null text has no words; null doc_ids come last; rows of one doc_id do not count as earlier than each
    other where they hold whole equal stretches, so wholly equal rows stay; further columns, whatever their
    names, go to ``row``; no rows give no rows.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                raw = text.as_buffer().to_pybytes()
                words = raw.split()
                gone = covered(starts.values, len(words), SIZE)
                counts.append(len(words))
                removed.append(runs(gone))
                if removed[-1]:
                    words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                kept.append(b" ".join(words) if tidy or removed[-1] else raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(counts, pa.int64()), pa.array(removed, RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
                ["row", "n_words", "removed", "kept"])

    read = keyed(docs)
    marked = with_starts(read, repeated_windows(read, METHOD))
    kind = read.schema["row"].dataType.simpleString()
    return marked.mapInArrow(cut, f"row {kind}, n_words long, removed array<struct<start:long,end:long>>, kept string")


def digests(done: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 from what ``remove_repeats`` returns."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return done.select("row.doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
