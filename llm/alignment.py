"""Alignment of two tokenizers over the same bytes, by as-of merges of token starts."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import held, slices, stored

#: Bytes of text that are aligned at once.
SLICE = 1 << 20
#: Bytes of text, about, whose id pairs share one list.
CHUNK = 16 << 20
#: Stretches of text whose ids a worker keeps, about 300 bytes each.
STRETCHES = 400_000
#: Longer stretches are not kept.
LONGEST = 64
#: Unknown stretches that are encoded as one text.
TOGETHER = 4096


@cache
def byte_level(path: str):
    """The tokenizer of byte-level entries, and the bytes of each id."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    value = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}
    size = library.get_vocab_size()
    entries = [library.id_to_token(i) or "" for i in range(size)]
    return library, [bytes(map(value.__getitem__, e)) if all(c in value for c in e) else e.encode() for e in entries]


@cache
def pieces(path: str):
    """The tokenizer of pieces, and the bytes of each id."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=path)
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    return library, [bytes([int(n[3:5], 16)]) if library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]


@cache
def _texts(size: int, marks: str) -> list[list[bytes]]:
    """Every id as text, followed by each of ``marks``."""
    return [[f"{i}{m}".encode() for i in range(size)] for m in marks]


class Tokens:
    """The tokens of one side: id, document, and the bytes from start to end in the joined documents."""

    def __init__(self, lists: list[bytes], widths: np.ndarray):
        self.ids = np.frombuffer(b"".join(lists), "<u4").astype(np.int64)
        self.count = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        self.doc = np.repeat(np.arange(len(lists)), self.count)
        self.ends = np.cumsum(widths[self.ids])
        self.starts = self.ends - widths[self.ids]


def covering(starts: Tokens, other: Tokens) -> np.ndarray:
    """For each token start, the token of the other side that covers it: the last that starts at or before it."""
    left = pd.DataFrame({"at": starts.starts, "doc": starts.doc})
    right = pd.DataFrame({"at": other.starts, "doc": other.doc, "token": np.arange(len(other.ids))})
    return pd.merge_asof(left, right, on="at", by="doc")["token"].to_numpy(np.int64)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose bytes overlap, each once: those met at a start of A, and at a start of B that is none of A's."""
    of_a, of_b = covering(a, b), covering(b, a)
    own = a.starts[of_b] != b.starts
    return np.concatenate([np.arange(len(a.ids)), of_b[own]]), np.concatenate([of_a, np.flatnonzero(own)])


def groups(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Ends where tokens of both sides end: for each token, how many such ends come before its own end."""
    common = np.intersect1d(a.ends, b.ends, assume_unique=True)
    return np.searchsorted(common, a.ends), np.searchsorted(common, b.ends)


def _digests(a: Tokens, b: Tokens, sizes: tuple[int, int]) -> tuple[np.ndarray, list[str]]:
    """Groups of each document, and the hash of ``a1,a2|b1;...`` over them."""
    group_a, group_b = groups(a, b)
    n = int(group_a[-1]) + 1 if len(group_a) else 0
    last_a = np.append(group_a[1:] != group_a[:-1], True) if n else np.zeros(0, bool)
    last_b = np.append(group_b[1:] != group_b[:-1], True) if n else np.zeros(0, bool)
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    # the tokens of A of a group come first, then those of B
    at_a = np.arange(len(a.ids)) + (np.cumsum(in_b) - in_b)[group_a]
    at_b = np.arange(len(b.ids)) + np.cumsum(in_a)[group_b]
    (a_in, a_last), (b_in, b_last) = _texts(sizes[0], ",|"), _texts(sizes[1], ",;")
    table = [*a_in, *a_last, *b_in, *b_last]
    code = np.empty(len(a.ids) + len(b.ids), np.int64)
    code[at_a] = a.ids + sizes[0] * last_a
    code[at_b] = 2 * sizes[0] + b.ids + sizes[1] * last_b
    listed = code.tolist()
    found, start = [], 0
    for end in np.cumsum(a.count + b.count).tolist():
        found.append(hashlib.sha256(b"".join(map(table.__getitem__, listed[start:end]))[:-1]).hexdigest() if end > start else "")
        start = end
    per_doc = np.bincount(a.doc[last_a], minlength=len(a.count)) if n else np.zeros(len(a.count), np.int64)
    return per_doc, found


#: A single space between other characters (U+2581 is a space to B): no token of either side runs over its start.
_GAP = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


@cache
def splits(a_path: str, b_path: str) -> bool:
    """Whether both sides encode the stretches between single spaces independently of each other.

    A does if it parts its text by the byte-level pattern, without normalizing; B if no piece holds a
    space after another character.
    """
    steps = json.loads(byte_level(a_path)[0].to_str())
    rule = steps["pre_tokenizer"] or {}
    entries = pieces(b_path)[1]
    return (steps["normalizer"] is None and rule.get("type") == "ByteLevel" and rule.get("use_regex", True)
            and not any(b" " in e.lstrip(b" ") for e in entries))


class Stretches(dict):
    """For a stretch of text: its ids on both sides, as little-endian 32-bit bytes, and whether both give back its bytes.

    A worker holds one table of at most ``STRETCHES``; a full one is emptied. Long stretches are not kept.
    """

    def __init__(self, paths: tuple[str, str]):
        (self.lib_a, self.bytes_a), (self.lib_b, self.bytes_b) = byte_level(paths[0]), pieces(paths[1])
        self.widths = _widths(paths[0], byte_level), _widths(paths[1], pieces)
        self.split = splits(*paths)

    def cut(self, text: str) -> list[str]:
        return _GAP.split(text) if self.split else [text]

    def meet(self, texts: list[list[str]]) -> dict:
        """The long stretches of ``texts``; the others are learnt."""
        if len(self) > STRETCHES:
            self.clear()
        new = list(set().union(*texts).difference(self))
        found = {}
        for i in range(0, len(new), TOGETHER):
            some = new[i:i + TOGETHER]
            for text, a, b, same in self._joined(some) or self._single(some):
                (self if len(text) <= LONGEST else found)[text] = a, b, same
        return found

    def _joined(self, texts: list[str]) -> Iterator | None:
        """The stretches encoded as one text and parted at their bytes; None if one of them stands against that."""
        line = " ".join(texts)
        if not self.split or len(_GAP.split(line)) != len(texts):
            return None
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        parted = []
        for ids, entries, widths in ((self.lib_a.encode_batch_fast([" " + line], add_special_tokens=False)[0].ids, self.bytes_a, self.widths[0]),
                                     (self.lib_b.encode(line), self.bytes_b, self.widths[1])):
            if b"".join(map(entries.__getitem__, ids)) != b" " + line.encode():
                return None
            ids = np.array(ids, "<u4")
            at = np.searchsorted(np.cumsum(widths[ids]), ends) + 1
            data, cuts = ids.tobytes(), (4 * at).tolist()
            parted.append([data[x:y] for x, y in zip([0, *cuts], cuts)])
        return zip(texts, *parted, repeat(b"\1"))

    def _single(self, texts: list[str]) -> Iterator:
        encoded = self.lib_a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for text, a, b in zip(texts, encoded, self.lib_b.encode(texts, num_threads=1), strict=True):
            a, b = (np.array(x, "<u4").tobytes() for x in (a.ids, b))
            yield text, a, b, b"\1" if self.whole(text, a, b) else b"\0"

    def whole(self, text: str, a: bytes, b: bytes) -> bool:
        """Whether the joined bytes of both sides are a space and the text."""
        a, b = (np.frombuffer(x, "<u4").tolist() for x in (a, b))
        return b"".join(map(self.bytes_a.__getitem__, a)) == b" " + text.encode() == b"".join(map(self.bytes_b.__getitem__, b))


def _encoded(texts: list[str | None], paths: tuple[str, str]) -> tuple[Tokens, Tokens]:
    """Both sides' tokens of each text; none where the joined bytes of either are not a space and the text."""
    table = held(("stretches", *paths), lambda: Stretches(paths))
    cut = [table.cut(t) if t else [] for t in texts]
    long = table.meet(cut)
    ids_a, ids_b = [], []
    for text, parts in zip(texts, cut):
        try:
            found = list(map(table.__getitem__, parts))
        except KeyError:
            found = [table.get(p) or long[p] for p in parts]
        a, b, same = map(b"".join, zip(*found)) if found else (b"", b"", b"\1")
        same = b"\0" not in same
        same = same or table.whole(text, a, b)
        ids_a.append(a if same else b"")
        ids_b.append(b if same else b"")
    return Tokens(ids_a, _widths(paths[0], byte_level)), Tokens(ids_b, _widths(paths[1], pieces))


@cache
def _widths(path: str, of) -> np.ndarray:
    return np.array([len(b) for b in of(path)[1]], np.int64)


def align(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """The alignment of every row of ``docs`` (doc_id, text), and the id pairs of each chunk of rows, in one table.

    Rows of documents have ``a`` null: chunk, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the
    document's distinct id pairs as ``pairs`` (places in the chunk's list) with ``times``. The other rows are
    the chunk's list: chunk, place, a, b, and how many links of the chunk hold the pair. A narrow job;
    a chunk is about ``chunk_bytes`` of text of one task, one document at least.

    Null and empty texts, and those that a tokenizer does not give back as they are, have zeros, empty
    arrays and an empty hash. Null doc_ids and repeated rows stay; further columns are ignored.
    """
    paths = a_path, b_path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = len(byte_level(a_path)[1]), len(pieces(b_path)[1])
        chunk, done = TaskContext.get().partitionId() << 32, []
        size = 0
        for batch in batches:
            for part in slices(batch, size=SLICE):
                done.append(_aligned(part, paths, sizes))
                size += part.column("text").nbytes
                if size >= chunk_bytes:
                    yield from _rows(chunk, done, sizes[1])
                    chunk, done, size = chunk + 1, [], 0
        if done:
            yield from _rows(chunk, done, sizes[1])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, (
        f"chunk long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<int>, times array<int>, place int, a int, b int, links long"))


def _aligned(part: pa.RecordBatch, paths: tuple[str, str], sizes: tuple[int, int]) -> dict:
    """One slice: its documents' figures, and their distinct id pairs in order of documents."""
    a, b = _encoded(part.column("text").to_pylist(), paths)
    n = part.num_rows
    of_a, of_b = overlaps(a, b)
    doc, code = a.doc[of_a], a.ids[of_a] * sizes[1] + b.ids[of_b]
    order = np.lexsort((code, doc))
    doc, code = doc[order], code[order]
    new = np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])) if len(code) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    n_groups, hashes = _digests(a, b, sizes)
    return {"doc_id": part.column("doc_id"), "n_a": a.count, "n_b": b.count, "n_groups": n_groups, "hashes": hashes,
            "n_links": np.bincount(doc, minlength=n), "code": code[at], "times": np.diff(np.append(at, len(code))),
            "pairs": np.bincount(doc[at], minlength=n)}


def _rows(chunk: int, done: list[dict], size_b: int) -> Iterator[pa.RecordBatch]:
    code = np.concatenate([h["code"] for h in done])
    times = np.concatenate([h["times"] for h in done])
    known, place = np.unique(code, return_inverse=True)
    links = np.bincount(place, times, len(known)).astype(np.int64)
    offsets = np.append(0, np.cumsum(np.concatenate([h["pairs"] for h in done])))
    ids = pa.chunked_array([h["doc_id"] for h in done]).combine_chunks()
    whole = lambda name: pa.array(np.concatenate([h[name] for h in done]).astype(np.int64))
    listed = lambda x: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32()))
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", "place", "a", "b", "links"]
    n = len(ids)
    none = lambda kind, n: pa.nulls(n, kind)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, chunk)), ids, whole("n_a"), whole("n_b"), whole("n_groups"), whole("n_links"),
         pa.array([x for h in done for x in h["hashes"]]), listed(place), listed(times),
         none(pa.int32(), n), none(pa.int32(), n), none(pa.int32(), n), none(pa.int64(), n)], names)
    m = len(known)
    if m:
        nothing = [none(ids.type, m), *(none(pa.int64(), m) for _ in range(4)), none(pa.string(), m), *(none(pa.list_(pa.int32()), m) for _ in range(2))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, chunk)), *nothing, pa.array(np.arange(m), pa.int32()), pa.array(known // size_b, pa.int32()),
             pa.array(known % size_b, pa.int32()), pa.array(links)], names)


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count, best: how many links of the corpus hold each id pair, and whether no pair of its b has more."""
    counts = aligned.where("a is not null").groupBy("a", "b").agg(F.sum("links").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignments(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs`` (doc_id, text).

    A is a byte-level BPE over a space and the text, B a sentencepiece model that adds the space. The
    aligned rows are stored once. Id pairs are summed up per chunk before they are shuffled, and the
    corpus counts go back to the chunks, each of which then meets its documents; no row per link or per
    pair of a document is ever shuffled. A pair that every chunk has is a hot key of the join back, with a
    row per chunk, which Spark splits.

    See :func:`align` for nulls, empty and unusual texts: their sums are 0. No rows give no rows.
    """
    aligned = stored(align(docs, a_path, b_path, chunk_bytes))
    lists = aligned.where("a is not null").select("chunk", "place", "a", "b").join(link_counts(aligned), ["a", "b"]).select(
        F.col("chunk").alias("of_chunk"), "place", "count", "best")
    rows = aligned.where("a is null").drop("place", "a", "b", "links")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        count, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, bool)
        place = right.column("place").to_numpy()
        count[place], best[place] = right.column("count").to_numpy(), right.column("best").to_numpy()
        pairs, times = (left.column(c).combine_chunks() for c in ("pairs", "times"))
        sizes = pairs.value_lengths().to_numpy(zero_copy_only=False)
        at, n = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
        ends = np.append(0, np.cumsum(sizes))
        sums = [np.append(0, np.cumsum(x)) for x in (n * best[at], n * count[at])]
        n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
        return left.drop_columns(["chunk", "pairs", "times"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column(
            "count_sum", pa.array(count_sum, pa.int64()))

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.groupBy("chunk").cogroup(lists.groupBy("of_chunk")).applyInArrow(weigh, (
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
