"""Benchmark decontamination by winnowing. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.shared import stored

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of a hashed k-gram; the least of WINDOW - GRAM + 1 consecutive ones is kept.
GRAM = 5
#: Fingerprints of the test items that may be broadcast (about 200 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _grams(hashes: Column, size: int) -> Column:
    """Hash of every ``size`` consecutive word hashes; empty for fewer words."""
    count = F.size(hashes) - (size - 1)
    return F.when(count > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
        lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(size))),
    )).otherwise(F.array().cast("array<bigint>"))


def _least(grams: Column) -> Column:
    """Positions of the k-grams that winnowing keeps: the rightmost least one of every window.

    Least of 6 = least of two overlapping stretches; the position breaks ties.
    """
    count = F.size(grams) - (WINDOW - GRAM)
    return F.when(count > 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
        lambda i: _rightmost(grams, i)))).otherwise(F.array().cast("array<int>"))


def _rightmost(grams: Column, i: Column) -> Column:
    width = WINDOW - GRAM + 1
    least = F.least(*(F.get(grams, i + j) for j in range(width)))
    place = F.lit(0)
    for j in range(1, width):
        place = F.when(F.get(grams, i + j) == least, F.lit(j)).otherwise(place)
    return i + place


def _fingerprints(hashes: Column, short: list[int]) -> Column:
    """Array of (kind, pos, hash): winnowed k-grams have kind 0, windows of n < WINDOW words kind n."""
    grams = F.col("grams")
    kept = F.transform(_least(grams), lambda p: _entry(F.lit(0), p, F.get(grams, p)))
    return F.concat(kept, *(_whole(hashes, n) for n in short)) if short else kept


def _whole(hashes: Column, n: int) -> Column:
    return F.transform(_grams(hashes, n), lambda h, p: _entry(F.lit(n), p, h))


def _entry(kind: Column, pos: Column, value: Column) -> Column:
    return F.struct(kind.cast("int").alias("kind"), pos.cast("int").alias("pos"), value.alias("hash"))


def _hashed(df: DataFrame) -> DataFrame:
    """With word hashes and the hashes of k-grams, each computed once."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("grams", _grams(F.col("hashes"), GRAM))


def _equal_run(start: Column, other_start: Column, step: int, limit: int) -> Column:
    """How many words, up to ``limit``, agree one after the other from the two positions on."""
    run = F.lit(limit)
    for j in range(limit - 1, -1, -1):
        same = F.coalesce(F.get("words", start + step * j) == F.get("item_words", other_start + step * j), F.lit(False))
        run = F.when(~same, j).otherwise(run)
    return run


def item_classes(items: DataFrame) -> DataFrame:
    """item_id, item_class, words of the items that have words; equal items are one class."""
    split = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return split.withColumn("item_class", F.sha2(F.array_join("words", " "), 256))


def hits(docs: DataFrame, items: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, text_hash, n_words, copies, spans, classes: the hit stretches of every distinct row of ``docs``.

    Both sides keep the rightmost least k-gram hash of every WINDOW - GRAM + 1 consecutive ones, so that
    two texts that share a window share a kept k-gram in the same place in it. Kept k-grams are joined on
    their hash, compared word by word, and extended both ways; a stretch of a window's length or more is
    a hit. Items shorter than a window are looked up whole, by length.

    The test items' fingerprints, each with the words that a window around it can reach, are counted first.
    Up to ``limit`` rows are broadcast; more are split by hash
    into blocks of at most about that size, each broadcast for its own pass over the documents, so no
    k-gram of a document is ever shuffled and a frequent one burdens no task.
    """
    classes = item_classes(items).select("item_class", F.col("words")).distinct()
    sized = classes.withColumn("n", F.size("words"))
    short = sorted(r["n"] for r in sized.where(F.col("n") < WINDOW).select("n").distinct().collect())
    reach = WINDOW - GRAM
    around = F.transform(F.sequence(F.lit(-reach), F.lit(WINDOW - 1)), lambda step: F.get("words", F.col("f.pos") + step))
    tests = _hashed(sized).select(
        "item_class", "words", "n", F.explode(_fingerprints(F.col("hashes"), short)).alias("f"),
    ).where((F.col("f.kind") == 0) | (F.col("f.kind") == F.col("n"))).select(
        "item_class", around.alias("item_words"), "f.kind", F.lit(reach).alias("item_pos"), "f.hash")
    blocks = -(-tests.count() // limit) or 1

    read = _hashed(docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words")))
    every = F.array(_entry(F.lit(-1), F.lit(0), F.lit(0).cast("long")))
    dealt = read.select("doc_id", "text_hash", "words", F.explode(F.concat(every, _fingerprints(F.col("hashes"), short))).alias("f"))
    dealt = dealt.select("doc_id", "text_hash", "words", "f.kind", "f.pos", "f.hash")

    found = None
    for block in range(blocks):
        side = tests if blocks == 1 else tests.where(F.pmod("hash", F.lit(blocks)) == block)
        met = dealt.join(F.broadcast(side), ["kind", "hash"], "left").where(
            F.col("item_class").isNotNull() | (F.col("kind") == -1))
        left = _equal_run(F.col("pos") - 1, F.col("item_pos") - 1, -1, reach)
        right = _equal_run(F.col("pos"), F.col("item_pos"), 1, GRAM + reach)
        whole = _equal_run(F.col("pos"), F.col("item_pos"), 1, WINDOW - 1)
        hit = F.when((F.col("kind") == 0) & (right >= GRAM) & (left + right >= WINDOW),
                     F.struct((F.col("pos") - left).alias("start"), (F.col("pos") + right).alias("end")))
        hit = hit.when((F.col("kind") > 0) & (whole >= F.col("kind")),
                       F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("kind")).alias("end")))
        rows = met.select(
            "doc_id", "text_hash", F.size("words").alias("n_words"), hit.alias("span"), "item_class",
            F.when((F.col("kind") == -1) & F.lit(block == 0), 1).alias("row"))
        found = rows if found is None else found.unionByName(rows)
    return found.where(F.col("row").isNotNull() | F.col("span").isNotNull()).groupBy("doc_id", "text_hash", "n_words").agg(
        F.count("row").alias("copies"), F.collect_set("span").alias("spans"),
        F.collect_set(F.when(F.col("span").isNotNull(), F.col("item_class"))).alias("classes"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``.

    ``docs`` has doc_id and text, ``items`` item_id and text. Stretches are merged per document; only hit
    documents meet the items again, to count them by id.

    Null text has no words; an item without words hits nothing; equal items count each; a null item_id is
    left out of the ids; null doc_ids and repeated rows stay, each with its own row; further columns are
    ignored. Without items nothing is hit; without documents there are no rows.
    """
    found = hits(docs, items)  # read twice below, so kept: one narrow row per document
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
    found = stored(found.withColumn("n_hit", covered.cast("long")).drop("spans"))
    ids = item_classes(items).select("item_class", F.col("item_id").cast("string").alias("item")).where("item is not null")
    key = ["doc_id", "text_hash", "n_words"]
    named = found.where("n_hit > 0").select(*key, F.explode("classes").alias("item_class")).join(
        ids.distinct(), "item_class").groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    renamed = named.select(*(F.col(c).alias(f"{c}_") for c in key), "item_ids")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in key]
    joined = found.join(renamed, same[0] & same[1] & same[2], "left").withColumn(
        "item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return joined.select(
        "doc_id", F.col("n_words").cast("long"), "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def without_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that share no window with an item; all columns stay, whatever their names."""
    found = hits(docs, items).where(F.size("spans") > 0).select(
        F.isnull("doc_id").alias("null_"), F.coalesce("doc_id", F.lit(0)).alias("id_"), "text_hash")
    rows = docs.select(
        F.isnull("doc_id").alias("null_"), F.coalesce("doc_id", F.lit(0)).alias("id_"), F.xxhash64("text").alias("text_hash"),
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(found, ["null_", "id_", "text_hash"], "left_anti").select("row.*")


#: The same rows in SQL: every window of every document against every window of every item.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM d, (SELECT DISTINCT n FROM sized) AS sizes WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
