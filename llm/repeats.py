"""Which windows of a corpus repeat: routing of anchored contexts to indexes of bounded size.

Shared by the byte and the word deduplication. Every window of ``size`` tokens has an anchor
(``llm.windows``); equal windows share it. So:

1. anchor occurrences are counted (partial sums first), and those of unrepeated anchors dropped;
2. equal contexts are counted and need no index: all occurrences of one (or all but the first) repeat;
3. each distinct context of an anchor with several is read back from its document and dealt by anchor, and
   a task indexes a bounded stretch of whole anchors at a time;
4. an anchor with more than ``CROWD`` distinct contexts is split: blocks of few windows have a longer
   common core, which takes the anchor's place, and at the last level single windows are counted. So a
   passage in a third of all documents never meets in one task.

Hashes have 64 bits; contexts are compared by anchor and context hash together, 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import slices, stored
from llm.windows import anchor_of, contexts_of, mix, prefix, spans

#: Distinct contexts of one anchor that an index takes.
CROWD = 1000
#: Tokens that a task indexes at a time, about; an anchor's contexts stay together.
SHARD = 1 << 20

_ROWS = "anchor long, context long, doc long, mark long, first int, last int, again boolean"
_TEXTS = "anchor long, context long, doc long, mark long, first int, n long, crowded boolean, tokens binary"
_FOUND = "doc long, mark long, first int, last int"


@dataclass(frozen=True)
class Method:
    """What differs between bytes and words."""

    #: Tokens of a text's bytes, as 64-bit values, and in the form (of type ``kind``) that goes to an index.
    tokens: Callable[[bytes], np.ndarray]
    compact: Callable[[bytes], np.ndarray]
    kind: str
    size: int
    k: int
    #: True: an occurrence repeats if an equal one starts earlier; False: if one starts anywhere else.
    ordered: bool
    #: Marks windows of contexts: (occurrences, tokens, anchors), a list of each, to a list of boolean arrays.
    index: Callable[[list[int], list[np.ndarray], list[int]], list[np.ndarray]]
    #: Windows per block at each level of splitting a crowded anchor; the last is 1.
    levels: tuple[int, ...]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchors(docs: DataFrame, method: Method) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [method.tokens(text.as_buffer().to_pybytes()) for text in part.column("text")]
                of, anchor, context, first, last = contexts_of(texts, method.size, method.k)
                if not len(of):
                    continue
                again = np.ones(len(of), bool)
                same = mix(of.astype(np.uint64)) ^ anchor ^ (context * np.uint64(3))
                again[np.unique(same, return_index=True)[1]] = False
                doc, mark = part.column("doc").to_numpy(), part.column("mark").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [_signed(anchor), _signed(context), pa.array(doc[of]), pa.array(mark[of]),
                     pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(again)],
                    ["anchor", "context", "doc", "mark", "first", "last", "again"])

    return docs.mapInArrow(find, _ROWS)


def _decide(rows: DataFrame, ordered: bool) -> DataFrame:
    """``rows`` of repeated anchors with ``direct`` (this occurrence repeats), ``lead`` (it stands for its
    context), ``total`` (occurrences of the context) and ``crowded`` (of the anchor).

    Needs anchor, context, doc, again and n, the occurrences that a row stands for.
    """
    same = rows.groupBy("anchor", "context").agg(F.sum("n").alias("total"), F.min("doc").alias("least"))
    of = same.groupBy("anchor").agg(F.count("*").alias("distinct_contexts"), F.sum("total").alias("occurrences"))
    known = same.join(of.where("occurrences > 1"), "anchor").select(
        "anchor", "context", "total", "least", F.col("distinct_contexts").alias("others"))
    lead = (F.col("doc") == F.col("least")) & ~F.col("again")
    joined = rows.join(known, ["anchor", "context"])
    direct = ~lead if ordered else F.col("total") > 1
    return joined.withColumn("lead", lead).withColumn("direct", direct).withColumn(
        "crowded", F.col("others") > CROWD).withColumn("alone", F.col("others") == 1)


def _texts(docs: DataFrame, wanted: DataFrame, method: Method) -> DataFrame:
    """The tokens of the wanted contexts, read from their documents; once for each of several equal rows."""
    # a set: equal rows want the same contexts, and each of them meets the whole list
    lists = wanted.groupBy("doc", "mark").agg(F.collect_set(F.struct(
        "anchor", "context", "first", "last", "total", "crowded")).alias("wanted"))
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = method.compact(batch.column("text")[i].as_buffer().to_pybytes())
                listed = batch.column("wanted").slice(i, 1).flatten()
                first, last = listed.field("first").to_numpy(), listed.field("last").to_numpy()
                texts = [tokens[a:b + method.size].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [listed.field("anchor"), listed.field("context"), pa.repeat(batch.column("doc")[i], n),
                     pa.repeat(batch.column("mark")[i], n), listed.field("first"), listed.field("total"),
                     listed.field("crowded"), pa.array(texts, pa.binary())],
                    ["anchor", "context", "doc", "mark", "first", "n", "crowded", "tokens"])

    return docs.join(lists, ["doc", "mark"]).select("doc", "mark", "text", "row", "wanted").mapInArrow(read, _TEXTS)


def _indexed(texts: DataFrame, method: Method) -> DataFrame:
    """Windows that repeat, found by an index over each shard of whole anchors.

    Rows of one doc and mark are equal and share what is found, so their contexts enter an index once:
    a second one would find the first there and both rows would lose the words.
    """
    kind = np.dtype(method.kind)

    def mark(shard: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(shard).combine_chunks()
        tokens = [np.frombuffer(x.as_buffer(), kind) for x in rows.column("tokens").combine_chunks()]
        marked = method.index(rows.column("n").to_pylist(), tokens, rows.column("anchor").to_pylist())
        which, first, last = [], [], []
        for i, flags in enumerate(marked):
            edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            which += [i] * len(starts)
            first.append(starts)
            last.append(ends)
        if which:
            base = rows.column("first").to_numpy()[which]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc").combine_chunks().take(pa.array(which)), rows.column("mark").combine_chunks().take(pa.array(which)),
                 pa.array((base + np.concatenate(first)).astype(np.int32)), pa.array((base + np.concatenate(last)).astype(np.int32))],
                ["doc", "mark", "first", "last"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[pa.RecordBatch] = []
        held, anchor, last = 0, None, None
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column("crowded")))
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("anchor", "doc", "mark", "first")])
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            fresh[0] = last is None or bool((keys[:, 0] != last).any())
            last = keys[:, -1]
            batch = batch.filter(pa.array(fresh))
            if not batch.num_rows:
                continue
            anchors = batch.column("anchor").to_numpy()
            cuts = np.flatnonzero(np.diff(anchors)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if held >= SHARD and anchors[a] != anchor:
                    yield from mark(shard)
                    shard, held = [], 0
                part = batch.slice(a, b - a)
                shard.append(part)
                held += part.column("tokens").nbytes // kind.itemsize if b - a == batch.num_rows else sum(
                    len(x.as_buffer()) for x in part.column("tokens")) // kind.itemsize
                anchor = anchors[b - 1]
        if shard:
            yield from mark(shard)

    return texts.sortWithinPartitions("crowded", "anchor", "doc", "mark", "first").mapInArrow(shards, _FOUND)


def _blocks(texts: DataFrame, method: Method, windows: int) -> DataFrame:
    """Crowded contexts cut into blocks of ``windows`` windows; the block's common core is its anchor.

    Blocks are counted from the context's anchor, so that a window lies in the same block wherever it
    occurs; the core is that of a whole block, also where the context holds only part of it. Blocks of
    several windows need contexts whose compact form is the text itself.
    """
    size, kind = method.size, np.dtype(method.kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("crowded"))
            which, anchors, hashes, first, bodies = [], [], [], [], []
            for i, body in enumerate(batch.column("tokens")):
                tokens = np.frombuffer(body.as_buffer(), kind)
                count = len(tokens) - size + 1
                at = anchor_of(method.tokens(body.as_buffer().to_pybytes())[:size], method.k) if windows > 1 else 0
                nominal = np.arange((at + 1) % windows - windows, count, windows)
                nominal = nominal[nominal + windows > 0]
                starts, ends = np.maximum(nominal, 0), np.minimum(nominal + windows, count) - 1 + size
                sums = prefix(mix(tokens.astype(np.uint64) + np.uint64(1)))
                anchors.append(spans(sums, nominal + windows - 1, nominal + size))
                hashes.append(spans(sums, starts, ends))
                which += [i] * len(starts)
                first.append(starts)
                bodies += [tokens[a:b].tobytes() if windows > 1 else b"" for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            if which:
                at = pa.array(which)
                base = batch.column("first").to_numpy()[which]
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(anchors)), _signed(np.concatenate(hashes)), batch.column("doc").take(at),
                     batch.column("mark").take(at), pa.array((base + np.concatenate(first)).astype(np.int32)),
                     batch.column("n").take(at), pa.array([False] * len(which)), pa.array(bodies, pa.binary())],
                    ["anchor", "context", "doc", "mark", "first", "n", "crowded", "tokens"])

    return texts.mapInArrow(cut, _TEXTS).drop("crowded").withColumn("again", F.lit(False))


def repeated_windows(docs: DataFrame, method: Method) -> DataFrame:
    """doc, mark, first, last: starts of windows that repeat. ``docs`` has doc, mark (its key) and text."""
    rows = _anchors(docs, method)
    # stored, so that the join deals both sides out anew and Spark can split the rows of a frequent anchor
    often = stored(rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    kept = stored(rows.join(often, "anchor", "left_semi").withColumn("n", F.lit(1).cast("long")))
    known = _decide(kept, method.ordered)
    out = known.where("direct").select("doc", "mark", "first", "last")
    texts = _texts(docs, known.where("lead and not alone"), method)
    return out.unionByName(_settle(texts, method, 0))


def _settle(texts: DataFrame, method: Method, level: int) -> DataFrame:
    """Index the contexts of ordinary anchors; split those of crowded ones and settle the blocks."""
    # dealt once for both: by anchor for the indexes, crowded contexts over all tasks; the tasks tell them apart
    deal = F.when(F.col("crowded"), F.xxhash64("doc", "first")).otherwise(F.col("anchor"))
    texts = texts.withColumn("deal", deal).repartition("deal").drop("deal")
    out = _indexed(texts, method)
    windows = method.levels[level]
    blocks = _blocks(texts, method, windows)
    if windows == 1:
        return out.unionByName(_counted(blocks, method))
    known = _decide(blocks, method.ordered)
    ends = F.col("first") + (F.length("tokens") / np.dtype(method.kind).itemsize).cast("int") - method.size
    own = F.lit(True) if method.ordered else F.col("n") == 1
    direct = known.where(F.col("direct") & own).select("doc", "mark", "first", ends.alias("last"))
    more = known.where("lead and not alone").select(
        "anchor", "context", "doc", "mark", "first", F.col("total").alias("n"), "crowded", "tokens")
    return out.unionByName(direct).unionByName(_settle(more, method, level + 1))


def _counted(blocks: DataFrame, method: Method) -> DataFrame:
    """Single windows, counted by hash."""
    least = blocks.groupBy("anchor", "context").agg(
        F.sum("n").alias("total"), F.min(F.struct("doc", "first")).alias("least")).where("total > 1")
    met = blocks.join(least, ["anchor", "context"])
    hit = (F.struct("doc", "first") > F.col("least")) if method.ordered else F.lit(True)
    return met.where(hit).select("doc", "mark", "first", F.col("first").alias("last"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc (the id; null last), mark (hash of the text), text (null as empty), row (all columns but text)."""
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(doc.alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"), F.struct(*rest).alias("row"))


def with_starts(read: DataFrame, found: DataFrame) -> DataFrame:
    """text, row, starts: the ranges of repeated window starts of each document, as one list."""
    lists = found.groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("starts"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return read.join(lists, ["doc", "mark"], "left").select("text", "row", F.coalesce("starts", none).alias("starts"))


def covered(starts: pa.Array, length: int, size: int) -> np.ndarray:
    """Which of ``length`` tokens a repeated window covers."""
    edge = np.zeros(length + 1, np.int32)
    if len(starts):
        np.add.at(edge, starts.field("first").to_numpy(), 1)
        np.add.at(edge, starts.field("last").to_numpy() + size, -1)
    return np.cumsum(edge[:length]) > 0


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def runs(flags: np.ndarray) -> list[dict[str, int]]:
    """Maximal stretches of set flags."""
    edge = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
