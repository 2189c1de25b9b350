"""Ranked lexical search by NRA: impact-sorted reads with lower and upper score bounds per document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.shared import stored

#: Test items, and terms of items, that are answered in one pass over the documents; more make more passes.
BLOCK_ITEMS, BLOCK_TERMS = 5_000, 500_000
#: Documents of a shard, whose lists are sorted and read together.
SHARD = 8192
#: Cells (documents by terms of an item) that a shard may have.
CELLS = 4_000_000
#: Entries of a list that the first round reads; each round reads twice as many.
FIRST_READ = 128

_PLAIN = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased."""
    return text.translate(_PLAIN).split()


def _bytes(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms (with repeats) of every row of ``items``."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[t.decode() for t in terms(_bytes(text))] for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.list_(pa.string()))], ["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(split, f"item_id {kind}, terms array<string>")


def term_counts(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """doc_id, n, term array<int>, tf array<int>: all terms of each row counted, and those of ``ids`` listed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(ids)
        for batch in batches:
            n, listed, times, ends = [], [], [], [0]
            for text in batch.column("text"):
                found = terms(_bytes(text))
                n.append(len(found))
                known = np.fromiter((i for i in map(ids.get, found) if i is not None), np.int64)
                term, tf = np.unique(known, return_counts=True)
                listed.append(term)
                times.append(tf)
                ends.append(ends[-1] + len(term))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x) if size else [], pa.int32()))
                     for x in (listed, times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, term array<int>, tf array<int>")


class Shard:
    """The impact-sorted lists of some documents: for each term its documents, the highest impact first."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, vocabulary: int):
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact, self.docs = doc[order], impact[order], docs
        self.start = np.searchsorted(term[order], np.arange(vocabulary + 1))

    def search(self, wanted: np.ndarray, repeats: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents that score at least ``floor`` and are among the ``k`` best, ties included, with exact scores.

        Each round reads on in every list. A document's score is at least what was read of it and at
        most that plus the last impact read of each list that has not shown it; an unseen document's at most the
        sum of those. Reading ends when no unseen document can reach the threshold, the k-th highest
        lower bound or ``floor``, and every seen one that still can has equal bounds.
        """
        starts, ends = self.start[wanted], self.start[wanted + 1]
        if not (ends - starts).sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        heads = np.array([int(self.impact[s]) if s < e else 0 for s, e in zip(starts, ends)], np.int64)
        kind = np.float64 if int((heads * repeats).sum()) < 1 << 53 else np.int64  # both exact; the first is faster
        repeats = repeats.astype(kind)
        lower = np.zeros(self.docs, kind)
        seen = np.zeros((self.docs, len(wanted)), kind)
        at, step = starts.copy(), FIRST_READ
        while True:
            last = np.zeros(len(wanted), kind)
            for i in np.flatnonzero(at < ends).tolist():
                stop = min(at[i] + step, ends[i])
                some = self.doc[at[i]:stop]
                lower[some] += repeats[i] * self.impact[at[i]:stop]
                seen[some, i] = 1
                at[i] = stop
                if stop < ends[i]:
                    last[i] = repeats[i] * self.impact[stop - 1]
            step *= 2
            unseen = last.sum()
            known = np.flatnonzero(lower > 0)
            reached = lower[known]
            best = max(np.partition(reached, -k)[-k] if len(known) > k else 0, floor, 1)
            if unseen >= best:
                continue
            upper = reached + unseen - seen[known] @ last
            still = upper >= best
            if (upper[still] == reached[still]).all():
                return known[still], reached[still].astype(np.int64)


def _impacts(n: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, length: int) -> np.ndarray:
    m = 100 - 25 + (25 * n * docs) // max(length, 1)
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


def _answers(counts: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """query, doc_id, score: the best of each task for each query."""
    longest = max((len(q[0]) for q in queries), default=1)
    size = max(min(SHARD, CELLS // max(longest, 1)), 64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists, times = part.column("term"), part.column("tf")
                each = lists.value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(part.num_rows), each)
                term = lists.flatten().to_numpy().astype(np.int64)
                tf = times.flatten().to_numpy().astype(np.int64)
                impact = _impacts(part.column("n").to_numpy()[doc], tf, weights[term], docs, length)
                some = impact > 0
                shard = Shard(doc[some], term[some], impact[some], part.num_rows, len(weights))
                ids = part.column("doc_id")
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                for q, (wanted, repeats) in enumerate(queries):
                    held = best.get(q)
                    floor = int(held[2][k - 1]) if held is not None and len(held[2]) >= k else 0
                    found, score = shard.search(wanted, repeats, k, floor)
                    if not len(found):
                        continue
                    new = missing[found], ids[found], score
                    if held is not None:
                        new = tuple(map(np.concatenate, zip(held, new)))
                    order = np.lexsort((new[1], new[0], -new[2]))[:k]
                    best[q] = tuple(x[order] for x in new)
        for q, (missing, ids, score) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, pa.int64(), mask=missing), pa.array(score, pa.int64())],
                ["query", "doc_id", "score"])

    return counts.select("doc_id", "n", "term", "tf").mapInArrow(search, "query int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 20, block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best rows of ``docs`` (doc_id bigint, text) for every row of ``items``.

    Scores are integers above 0; equal ones go by ascending doc_id, a null doc_id last. A pass counts every
    document's terms, keeps those that the items ask for in one narrow row per document, stored once, and
    sums them up for the weights. The rows are then read task by task in shards, each with impact-sorted
    lists of its own, and every item is answered on each by NRA; what a task has found so far is its
    threshold on the next shard. A task passes on at most ``k`` rows an item, which are ranked per
    item at the end. No posting is shuffled, so a frequent term burdens no task.

    The items of a pass and their terms, held by driver and workers, are bounded by ``block_items`` and about
    ``block_terms``; items beyond are answered by further passes.

    Null text has no terms; items without known terms have no rows; repeated rows and null ids of either
    table count each for itself; further columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    split = stored(item_terms(items))
    size, total = split.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(-(-size // block_items), -(-total // block_terms), 1)
    answers = None
    for block in range(blocks):
        some = split if blocks == 1 else split.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block)
        rows = some.collect()
        ids = {t.encode(): i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        if not ids:
            continue
        counts = stored(term_counts(docs, ids))
        n, length = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(ids), np.int64)
        for r in counts.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        queries = [np.unique([ids[t.encode()] for t in r["terms"]] or np.zeros(0, np.int64), return_counts=True) for r in rows]
        found = _answers(counts, [(w.astype(np.int64), c) for w, c in queries], weights, n, length, k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(i, r["item_id"]) for i, r in enumerate(rows)], f"query int, item_id {kind}")
        answer = ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        answers = answer if answers is None else answers.unionByName(answer)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if answers is None else answers


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: The same rows in SQL: every document that has a term of an item is scored.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
q AS (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark),
qt AS (SELECT item_id, term, count(*) AS q FROM q GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d)
      WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t GROUP BY term),
p AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * (SELECT n_docs FROM s)) // (SELECT n_terms FROM s))))) AS part
      FROM t JOIN f USING (term)),
r AS (SELECT item_id, doc_id, sum(q * part)::BIGINT AS score FROM qt JOIN p USING (term) GROUP BY ALL HAVING sum(q * part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""
