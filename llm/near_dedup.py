"""Near-duplicates by the Jaccard similarity of word shingles: SimHash and min-wise blocks, then an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm import simhash
from llm.shared import stored

#: Documents are linked if their sets of so many words in a row are at least so alike.
SHINGLE = 5
SIMILARITY = 0.8
#: A text's min-wise values are split into blocks; texts of similarity s share one with 1 - (1 - s ** ROWS) ** BLOCKS.
BLOCKS = 16
ROWS = 6
#: A block of more texts than this yields no pairs: its texts meet a hub, the rest is dealt to narrower blocks.
CROWD = 64
_STEP = 4096
_KEY = ["null_", "id_", "mark"]


def shingles(text: bytes, size: int) -> np.ndarray:
    """The 64-bit hashes of all runs of ``size`` words, repeats included; fewer words are one run, none give none."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - size + 1]
    spans = zip(starts.tolist(), ends[size - 1:].tolist(), strict=True)
    return np.fromiter((xxh64_intdigest(line[a:b], simhash.SEED) for a, b in spans), np.uint64, len(starts))


def bits(hashes: np.ndarray) -> int:
    """SimHash of hashes: a bit is set if it is in over half of them; signed."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        rows = hashes[i:i + _STEP].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(simhash.SEED)
    values = draw.integers(0, 1 << 64, (2, BLOCKS * ROWS, 1), np.uint64)
    return values[0] | np.uint64(1), values[1]


def blocks(members: np.ndarray) -> list[int]:
    """One key for each block of the set's min-wise values; none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(members):
        return []
    times, plus = _factors()
    least = np.full(BLOCKS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(members), _STEP):
        np.minimum(least, (members[i:i + _STEP] * times + plus).min(axis=1), out=least)
    return [_signed(xxh64_intdigest(rows.tobytes(), i)) for i, rows in enumerate(least.reshape(BLOCKS, ROWS))]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _raw(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text"))


def _keyed(docs: DataFrame) -> DataFrame:
    """The key of a row (doc_id, null last, then its text's hash) and its text, whatever other columns there are."""
    doc = docs["doc_id"]
    return docs.select(F.isnull(doc).alias("null_"), F.coalesce(doc.cast("long"), F.lit(0)).alias("id_"),
                       simhash._mark(docs).alias("mark"), docs["text"].alias("text"))


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Key of each row, node (hash of its set of shingles), n (members), print (SimHash), keys (min-wise blocks)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            rows = []
            for text in _raw(batch):
                hashes = shingles(text, size)
                members = np.unique(hashes)
                rows.append((_signed(xxh64_intdigest(members.tobytes())), len(members), bits(hashes), blocks(members)))
            nodes, counts, prints, keys = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in _KEY), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], [*_KEY, "node", "n", "print", "keys"])

    return _keyed(docs).mapInArrow(
        of, "null_ boolean, id_ long, mark long, node long, n long, print long, keys array<long>")


def members(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """node, members (distinct hashes of shingles) for rows of (node, text)."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(_raw(batch)):
                found = np.unique(shingles(text, size)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, 1), pa.array([found], pa.list_(pa.int64()))], ["node", "members"])

    return texts.select("node", "text").mapInArrow(of, "node long, members array<long>")


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b and more) with ``alike``, the exact Jaccard similarity of their sets."""
    a = sets.select(F.col("node").alias("a"), F.col("members").alias("of_a"))
    b = sets.select(F.col("node").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(a, "a").join(b, "b").withColumn(
        "alike", both / (F.size("of_a") + F.size("of_b") - both)).drop("of_a", "of_b")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` whose sets are at least so alike."""
    return _measured(pairs, sets).where(F.col("alike") >= similarity).drop("alike")


def _beside(measured: DataFrame, similarity: float) -> DataFrame:
    """a, b: nodes of one block that may be alike, though only ``a`` is linked to the hub.

    One less the similarity is a distance that keeps the triangle inequality, so the two are not further apart
    in their distance to the hub than from each other.
    """
    apart = 1 - similarity + 1e-9
    to = F.col("alike")
    linked = measured.where(to >= similarity).select("key", F.col("b").alias("a"), F.col("n").alias("n_a"), to.alias("to_a"))
    others = measured.where((to < similarity) & (to >= similarity - apart)).select("key", "b", F.col("n").alias("n_b"), to.alias("to_b"))
    return linked.join(others, "key").where(F.col("to_a") - F.col("to_b") <= apart).where(
        _near_sizes(F.col("n_a"), F.col("n_b"), similarity)).select("a", "b")


def _near_sizes(a: Column, b: Column, similarity: float) -> Column:
    """Sets of a and b members can be so alike."""
    return F.least(a, b) / F.greatest(a, b) >= similarity


def _shared(dealt: DataFrame) -> DataFrame:
    """The rows of ``dealt`` whose key more than one node has, with ``size``, the number of these."""
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return stored(dealt.join(sizes, "key"))


def _few(shared: DataFrame, similarity: float, crowd: int) -> DataFrame:
    one = shared.where(F.col("size") <= crowd).select("key", F.col("node").alias("a"), F.col("n").alias("n_a"))
    two = one.select("key", F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    return one.join(two, "key").where("a < b").where(_near_sizes(F.col("n_a"), F.col("n_b"), similarity)).select("a", "b")


def _print_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: nodes whose SimHash prints are equal or linked, each print by its least node."""
    least = nodes.groupBy("print").agg(F.min("node").alias("a"))
    same = nodes.join(least, "print").where("a <> node").select("a", F.col("node").alias("b"))
    near = simhash.links(nodes.select("print")).withColumnsRenamed({"a": "p", "b": "q"})
    other = least.withColumnsRenamed({"print": "q", "a": "b"})
    across = near.join(least.withColumnRenamed("print", "p"), "p").join(other, "q").select("a", "b")
    return same.unionByName(across)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(found: DataFrame, docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY,
          crowd: int = CROWD) -> DataFrame:
    """a, b: links between the nodes of ``found`` (the sketches of ``docs``), each checked on whole shingle sets.

    Candidates share a block, or have SimHash prints within two bits. A block of at most ``crowd`` nodes yields its
    pairs. In a larger one each node meets one hub, so rows stay in proportion; a node that is linked to the hub is
    settled there, but for its links to nodes that are not, see :func:`_beside`. These others
    are dealt again by every block that follows in a circle from the first. The hub is the
    node whose blocks have the most members in all: in a group of edited copies that is the text they are copies of, or one
    close to it, to which more of them are alike than to each other. Groups of true
    near-duplicates settle at once; texts that only share a passage part in a few rounds. After the last block
    of the circle nothing is left to part by, and those that are not settled yield their pairs.
    """
    key = F.struct(*_KEY)
    nodes = stored(found.groupBy("node").agg(F.min(key).alias("row"), *(
        F.first(c).alias(c) for c in ("n", "print", "keys"))).where("n > 0"))
    dealt = nodes.select("node", "n", F.posexplode("keys").alias("start", "key")).withColumn("off", F.lit(0))
    shared = _shared(dealt)
    by_print = stored(_ordered(_print_pairs(nodes)))
    wanted = shared.select("node").unionByName(by_print.select(F.col("a").alias("node"))).unionByName(
        by_print.select(F.col("b").alias("node"))).distinct()
    rows = nodes.join(wanted, "node", "left_semi").select("node", "row.*")
    sets = stored(members(_keyed(docs).join(rows, _KEY), size).groupBy("node").agg(F.first("members").alias("members")))
    central = stored(shared.groupBy("node").agg(F.sum("size").alias("central")))
    pairs, stars = [by_print], []
    while True:
        pairs.append(_few(shared, similarity, crowd))
        crowded = shared.where(F.col("size") > crowd).drop("size")
        if crowded.isEmpty():
            break
        rank = F.struct("central", F.xxhash64("node", "key"))
        hubs = crowded.join(central, "node").groupBy("key").agg(F.max_by("node", rank).alias("a"))
        met = crowded.withColumnRenamed("node", "b").join(hubs, "key").where("a <> b")
        measured = stored(_measured(met.select("key", "a", "b", "n"), sets))
        star = measured.where(F.col("alike") >= similarity)
        stars.append(star.select("a", "b"))
        pairs.append(stored(_ordered(_beside(measured, similarity))))
        rest = met.select("key", "start", "off", "n", F.col("b").alias("node")).join(
            star.select("key", F.col("b").alias("node")), ["key", "node"], "left_anti")
        pairs.append(_few(rest.where(F.col("off") == BLOCKS - 1).withColumn("size", F.lit(0)), similarity, crowd))
        # only the blocks that follow in the circle
        steps = F.sequence(F.col("off") + 1, F.lit(BLOCKS - 1))
        follow = F.transform(steps, lambda step: F.struct(
            step.alias("step"), F.get("keys", F.pmod(F.col("start") + step, F.lit(BLOCKS))).alias("inner")))
        later = rest.where(F.col("off") < BLOCKS - 1).join(nodes.select("node", "keys"), "node").select(
            "node", "n", "start", F.col("key").alias("outer"), F.inline(follow))
        shared = _shared(later.select(
            "node", "n", "start", F.xxhash64("outer", "inner").alias("key"), F.col("step").alias("off")))
    checked = _alike(_ordered(reduce(DataFrame.unionByName, pairs)), sets, similarity)
    return _ordered(reduce(DataFrame.unionByName, stars, checked))


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) of which one for each component of near-duplicates stays: that of least doc_id.

    Two texts are linked if the sets of their runs of ``size`` words (A-Z lower-cased) have a Jaccard similarity of
    at least ``similarity``. Every link is exact; a pair at the threshold is found with 0.99, see BLOCKS. Null, empty
    and blank texts have no words and are one group. A text of fewer words is one run.

    All columns stay, whatever their names. A row without doc_id stays only if no other is in its component;
    of rows with one doc_id the one whose text has the least hash stays, and one of wholly equal rows. No rows give none.
    """
    from llm.components import components

    found = stored(sketches(docs, size))
    roots = components(links(found, docs, size, similarity, crowd))
    first = found.groupBy("node").agg(F.min(F.struct(*_KEY)).alias("key"))
    kept = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min("key").alias("key")).select("key.*")
    rows = docs.select(
        F.isnull("doc_id").alias("null_"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id_"),
        simhash._mark(docs).alias("mark"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    nth = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.lit(0)))
    return rows.join(kept, _KEY, "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")
