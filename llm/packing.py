"""Packing of documents into training sequences: bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.pretokens import words
from llm.shared import stored

#: Bins that a packer keeps open.
OPEN_BINS = 8192
#: Pieces that one packer gets, about.
PIECES = 12_000


def token_pieces(docs: DataFrame, path: str, length: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids, ended by ``end_id``, cut only if too long.

    Null text is an empty document, which is its end id alone. A narrow job without shuffle.
    """
    stop, step = end_id.to_bytes(4, "little"), 4 * length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words(path)
        for batch in batches:
            for part, texts in table.ids(batch):
                rows, piece, start, size, crc = [], [], [], [], []
                for i, text in enumerate(texts):
                    ids = b"".join([*text, stop])
                    for k, at in enumerate(range(0, len(ids), step)):
                        some = ids[at:at + step]
                        rows.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        size.append(len(some) // 4)
                        crc.append(zlib.crc32(some))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                     *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best fit with at most ``bins`` open bins.

    ``free`` has a bit for each amount of free space that an open bin has, ``at`` the bins by free space.
    The lowest bit at or above a size is the best fit. If a new bin is needed and all are open, the
    fullest (the lowest bit) closes first.
    """

    def __init__(self, capacity: int, bins: int = OPEN_BINS):
        self.capacity, self.bins = capacity, bins
        self.free, self.at = 0, [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, space: int) -> int:
        found = self.at[space].pop()
        if not self.at[space]:
            self.free ^= 1 << space
        self.open -= 1
        return found

    def put(self, size: int) -> tuple[int, int]:
        """The bin that takes ``size`` and the offset there."""
        fits = self.free >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            found = self._take(space)
        else:
            if self.open >= self.bins:
                self._take((self.free & -self.free).bit_length() - 1)
            space, found = self.capacity, self.made
            self.made += 1
        rest = space - size
        if rest:
            self.at[rest].append(found)
            self.free |= 1 << rest
            self.open += 1
        return found, self.capacity - space


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 1, bins: int = OPEN_BINS) -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset.

    ``docs`` has doc_id and text. Tokenizing is narrow; its narrow rows (no text, no ids) are stored once
    in the shared folder and counted, so that each packer gets about ``PIECES`` pieces, dealt without
    regard to source or id: no group of copies or hot source meets in one task. Packers take their
    pieces longest first. A bin is a full sequence or one of at most ``bins`` open ones, which a bitset
    keyed by free space holds; the fullest closes first. At the end of a packer open bins stay as they
    are, fewer than one in a hundred sequences as a rule.

    Null text is an empty document (only the end id). Null ids and repeated rows are packed like any
    other; further columns are ignored; an empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, path, length, end_id))
    parts = -(-pieces.count() // PIECES) or 1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, first = BestFit(length, bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [packer.put(n) for n in batch["length"].tolist()]
            batch["sequence_id"] = [first + s for s, _ in placed]
            batch["offset"] = [o for _, o in placed]
            yield batch

    dealt = pieces.withColumn("deal", F.xxhash64("doc_id", "piece", "ids_crc32"))
    return (
        dealt.repartition(parts, "deal").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
        .drop("deal").mapInPandas(place, pieces.schema.add("sequence_id", "long").add("offset", "long"))
    )
