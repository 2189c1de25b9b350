"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.components import components
from llm.shared import stored

SHINGLE = 3
SEED = 42
#: Fingerprints that differ in at most so many bits are linked.
DISTANCE = 2
#: A fingerprint is split into so many blocks; close pairs agree in BLOCKS - DISTANCE of them.
BLOCKS = 4
#: Blocks shared by more fingerprints than this meet through their midpoints instead of in pairs.
CROWD = 64
_STEP = 1 << 16


def simhash(text: bytes) -> int:
    """The fingerprint of one text: a bit is set if it is in over half the shingles' hashes."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(words) - size + 1]
    ends = ends[size - 1:]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _STEP):
        hashes = b"".join([xxh64_digest(line[a:b], SEED)
                           for a, b in zip(starts[i:i + _STEP].tolist(), ends[i:i + _STEP].tolist(), strict=True)])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), print (the 64 bits as a bigint) for every row; null text has no words."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(found, pa.int64())], ["doc_id", "mark", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", _mark(docs).alias("mark"), "text")
    return marked.mapInArrow(of, f"doc_id {kind}, mark long, print long")


def _mark(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _keys(value: Column) -> Column:
    """Array of (choice of blocks, bits of those blocks): one for each way to agree."""
    width = 64 // BLOCKS
    masks = [sum(((1 << width) - 1) << width * b for b in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - DISTANCE)]
    return F.array(*(F.struct(F.lit(i).alias("way"), value.bitwiseAND(F.lit(_signed(m))).alias("bits"))
                     for i, m in enumerate(masks)))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links that join every pair of distinct ``print`` values within DISTANCE bits.

    Each value is dealt to one key per choice of two of its four blocks. Two values within two bits
    agree in at least two blocks, so they share a key, are joined there and then verified. A key with more
    than ``crowd`` values yields no pairs: its values go to all values one bit away outside the agreed
    blocks (and to themselves), and those that meet at such a midpoint are within two bits; tying each
    to the least there loses no connection. Rows stay a fixed multiple of the values.
    """
    dealt = prints.select("print").distinct().select("print", F.explode(_keys(F.col("print"))).alias("key")).select(
        "print", "key.way", "key.bits")
    sizes = dealt.groupBy("way", "bits").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(dealt.join(sizes, ["way", "bits"]))
    few = shared.where(F.col("n") <= crowd).drop("n")
    other = few.withColumnRenamed("print", "b")
    pairs = few.withColumnRenamed("print", "a").join(other, ["way", "bits"]).where("a < b").where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE).select("a", "b")
    width = 64 // BLOCKS
    free = F.array(*(
        F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << width * b + j)) for b in range(BLOCKS) if b not in chosen for j in range(width)))
        for chosen in combinations(range(BLOCKS), BLOCKS - DISTANCE)))
    middle = shared.where(F.col("n") > crowd).select(
        "print", "way", F.explode(F.get(free, F.col("way"))).alias("flip")).select(
        "print", "way", F.col("print").bitwiseXOR(F.col("flip")).alias("mid"))
    least = middle.groupBy("way", "mid").agg(F.min("print").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = middle.join(least, ["way", "mid"]).select("a", F.col("print").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def _classes(found: DataFrame) -> DataFrame:
    """print, root: the component of every fingerprint."""
    values = found.select("print").distinct()
    roots = components(links(values)).withColumnRenamed("node", "print")
    return values.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text).

    Links run between fingerprints within two bits; the component's id is its least doc_id. Equal
    fingerprints are one node, so a group of copies weighs no more than a single document.

    Null or empty text has the fingerprint zero and is linked like any other. A null doc_id is never the
    least unless all are null; repeated rows stay; further columns are ignored; no rows give no rows.
    """
    found = stored(fingerprints(docs))
    nodes = found.groupBy("print").agg(F.min("doc_id").alias("least_id")).join(_classes(found), "print")
    least = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = nodes.join(least, "root").select("print", "component_id")
    return found.join(classes, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` of which one for each component stays: that of least doc_id.

    All columns stay, whatever their names. A row without doc_id stays only if no other is in its component;
    of rows with one doc_id the one whose text has the least hash stays, and one of wholly equal rows.
    """
    found = stored(fingerprints(docs))
    key = F.struct(F.isnull("doc_id").alias("null_"), F.coalesce("doc_id", F.lit(0)).alias("id_"), "mark")
    rooted = found.select("print", key.alias("key")).groupBy("print").agg(F.min("key").alias("key")).join(_classes(found), "print")
    kept = rooted.groupBy("root").agg(F.min("key").alias("key")).select("key.*")
    rows = docs.select(
        F.isnull("doc_id").alias("null_"), F.coalesce("doc_id", F.lit(0)).alias("id_"), _mark(docs).alias("mark"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keys = ["null_", "id_", "mark"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    return rows.join(kept, keys, "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")
