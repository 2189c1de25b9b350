"""Byte dedup by a run-length index: run-compressed BWT with sampled run ends, streamed statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.repeats import RUNS, Method, covered, keyed, repeated_windows, runs, with_starts
from llm.windows import mix, prefix, spans

#: Bytes of a repeated string.
SIZE = 400
#: Bytes of an anchor's k-gram.
GRAM = 160

#: Symbols that are packed in one sort key (9 bits each, 0 for a terminator).
_PACK = 7
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class RunIndex:
    """Run-length index of a set of texts.

    Texts are joined with terminators, all different, in the order of the texts. The Burrows-Wheeler
    transform is kept as its runs: for the head and the end of each run, the text position of its suffix
    and how far it agrees with the suffix before (after) it in sorted order. Inside a run the agreement of
    a position is one less than that of the position before it in the text, so these samples give the
    matching statistics of every position against all others.
    """

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        self.length = int(lengths.sum() + len(texts))
        symbols = np.zeros(self.length, np.uint64)
        for start, text in zip(self.starts.tolist(), texts, strict=True):
            symbols[start:start + len(text)] = text.astype(np.uint64) + np.uint64(1)
        order = _suffixes(symbols)
        before = symbols[order - 1].astype(np.int64)
        ended = before == 0
        before[ended] = -1 - np.flatnonzero(ended)  # terminators differ from each other
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.runs = len(change) + 1
        agree = _agreement(symbols, order[change - 1], order[change])
        self.heads = np.concatenate([order[:1], order[change]]), np.concatenate([[0], agree])
        self.ends = np.concatenate([order[change - 1], order[-1:]]), np.concatenate([agree, [0]])

    def statistics(self) -> np.ndarray:
        """For each position, in one pass over the text: the longest match that starts anywhere else."""
        return np.maximum(*(_streamed(at, agree, self.length) for at, agree in (self.heads, self.ends)))


def _streamed(at: np.ndarray, agree: np.ndarray, length: int) -> np.ndarray:
    sampled = np.zeros(length, np.int64)
    value = np.zeros(length, np.int64)
    sampled[at], value[at] = at, agree
    last = np.maximum.accumulate(sampled)
    return np.maximum(value[last] - (np.arange(length) - last), 0)


def _suffixes(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffixes by prefix doubling; only groups that are still tied are sorted again."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(_PACK, np.uint64)])
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(_PACK):
        symbol = padded[j:j + n]
        alive &= symbol > 0
        key = (key << np.uint64(9)) | np.where(alive, symbol, 0)
    order = np.argsort(key, kind="stable")
    ended = ~alive[order]
    fresh = np.ones(n, bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | ended[1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    width = _PACK
    while True:
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            return order
        at = order[slots]
        joint = (rank[at] << 32) | rank[np.minimum(at + width, n - 1)]
        by = np.argsort(joint, kind="stable")
        at, joint = at[by], joint[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = joint[1:] != joint[:-1]
        fresh[slots] = new
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        width *= 2


def _agreement(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, up to a terminator: by bisection on hashes."""
    ends = np.flatnonzero(symbols == 0)
    limit = np.minimum(ends[np.searchsorted(ends, a)] - a, ends[np.searchsorted(ends, b)] - b)
    sums = prefix(mix(symbols + np.uint64(7)))
    low, high = np.zeros(len(a), np.int64), limit
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) // 2
        x, y = a[open_], b[open_]
        same = spans(sums, x, x + mid) == spans(sums, y, y + mid)
        low[open_] = np.where(same, mid, low[open_])
        high[open_] = np.where(same, high[open_], mid - 1)


def tokens(text: bytes) -> np.ndarray:
    return _BYTE_VALUES[np.frombuffer(text, np.uint8)]


def _bytes(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8)


def _mark(weights: list[int], texts: list[np.ndarray], anchors: list[int]) -> list[np.ndarray]:
    """Windows of contexts that occur once which another context has too."""
    index = RunIndex(texts)
    found = index.statistics() >= SIZE
    return [found[s:s + len(t) - SIZE + 1] & (n == 1)
            for s, t, n in zip(index.starts.tolist(), texts, weights, strict=True)]


METHOD = Method(tokens=tokens, compact=_bytes, kind="u1", size=SIZE, k=GRAM, ordered=False, index=_mark, levels=(16, 1))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """row, n_bytes, removed, kept for every row of ``docs`` (doc_id, text).

    ``row`` has the input's columns without text, ``removed`` the maximal removed runs (start, end) in
    bytes of the text in UTF-8, ``kept`` the bytes that remain. A byte goes if a string of SIZE bytes that
    covers it also starts anywhere else, in the same document or another. Strings never cross documents,
    and removal looks at the input alone.

    Candidates are routed to run-length indexes of bounded size (``llm.repeats``); whole copies and
    equal stretches are settled by counting before that. Text is shuffled once, by document.

    Null text is empty; a null doc_id is an id like any other; wholly equal rows are copies of each
    other and lose their bytes like other copies; further columns, whatever their names, go to ``row``;
    no rows give no rows.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, removed, kept = [], [], []
            for text, starts in zip(batch.column("text"), batch.column("starts"), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone = covered(starts.values, len(raw), SIZE)
                lengths.append(len(raw))
                removed.append(runs(gone))
                kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(lengths, pa.int64()), pa.array(removed, RUNS), pa.array(kept, pa.binary())],
                ["row", "n_bytes", "removed", "kept"])

    read = keyed(docs)
    marked = with_starts(read, repeated_windows(read, METHOD))
    kind = read.schema["row"].dataType.simpleString()
    return marked.mapInArrow(cut, f"row {kind}, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def digests(done: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 from what ``remove_repeats`` returns."""
    return done.select(
        "row.doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
