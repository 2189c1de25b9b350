"""Known keys of a table written batch by batch, behind Bloom filters.

Every batch stores its keys, dealt into parts by hash and sorted by them, and for each part a filter of
64-bit words: a key sets eight bits of one word. Keys that no filter shows are new and need no look
at the stored keys. For the rest, about 1 in 20,000 besides those truly stored, only the parts are read whose
filter shows one, which Parquet finds by its page statistics, and compared exactly.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrawl.plans.lineage import stored_once
from pagetrawl.sources.folded import newest_fold, read_folded
from pagetrawl.sources.tables import read_if_there, write_batch

#: Parts of a batch, each with a filter of its own.
PARTS = 1024
#: So many parts of a batch are asked for one by one; more by their range, and Spark then leaves out the others.
SINGLE_PARTS = 64
#: Keys for each 64-bit word of a filter, that is 32 bits for a key.
KEYS_PER_WORD = 2
_BITS = 8

_KEYS = T.StructType([T.StructField("id", T.StringType()), T.StructField("part", T.IntegerType())])
_FILTERS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("words", T.LongType()),
    T.StructField("word", T.LongType()), T.StructField("bits", T.LongType())])


def _part() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")


def _word(words: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64("id"), 16), words)


def _mask() -> Column:
    places = (f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(id, 1), {6 * i}) & 63 as int))" for i in range(_BITS))
    return reduce(Column.bitwiseOR, map(F.expr, places))


def _write(keys: DataFrame, path: str, batch: int) -> None:
    spark = keys.sparkSession
    dealt = keys.select(F.col("id").cast("string").alias("id")).filter("id is not null").select("id", _part().alias("part"))
    by_part = dealt.repartition("part").distinct().sortWithinPartitions("part", "id")
    write_batch(by_part, f"{path}/ids", batch)
    known = spark.read.schema(_KEYS).parquet(f"{path}/ids/batch_id={batch}")
    words = F.lit(known.count() // (PARTS * KEYS_PER_WORD) + 1).cast("long")
    filled = known.groupBy("part", words.alias("words"), _word(words).alias("word")).agg(F.bit_or(_mask()).alias("bits"))
    write_batch(filled.sortWithinPartitions("part", "word"), f"{path}/filters", batch)


def write_keys(keys: DataFrame, path: str, batch: int) -> None:
    """The column ``id`` of ``keys`` as the known keys of batch ``batch``, with their filters; nulls are left out.

    A batch that is written again replaces itself.
    """
    _write(keys, path, batch)


def fold_keys(spark: SparkSession, path: str, upto: int) -> None:
    """The keys of all batches up to ``upto`` as one, so that a key is tested once for them; run between batches."""
    earlier = newest_fold(spark, path, "filters", upto)
    _write(read_folded(spark, _KEYS, path, "ids", upto + 1, earlier), f"{path}/folded", upto)


def _nothing(path: str, before: int | None, spark: SparkSession) -> bool:
    """Whether there is no batch before ``before``."""
    return before == 0 or read_if_there(spark, _FILTERS, f"{path}/filters") is None


def possible(items: DataFrame, path: str, before: int | None = None) -> DataFrame:
    """``id, batch_id, part``: where a key of ``items`` may be stored; a stored key is always shown.

    Keys meet the words of the filters, 4 bytes a key, in a join on batch, part and word.
    """
    spark = items.sparkSession
    filters = read_folded(spark, _FILTERS, path, "filters", before)
    # one row per batch after the fold, as many as there are folders to list
    sizes = [] if _nothing(path, before, spark) else filters.groupBy("batch_id").agg(F.max("words").alias("words")).collect()
    if not sizes:
        return spark.createDataFrame([], "id string, batch_id long, part int")
    batches = F.array(*(F.struct(F.lit(r.batch_id).cast("long").alias("batch_id"), F.lit(r.words).cast("long").alias("words")) for r in sizes))
    asked = items.select(F.col("id").cast("string").alias("id")).filter("id is not null").distinct()
    tests = asked.select("id", _part().alias("part"), _mask().alias("mask"), F.inline(batches))
    tests = tests.select("id", "batch_id", "part", _word(F.col("words")).alias("word"), "mask")
    met = tests.join(filters.select("batch_id", "part", "word", "bits"), ["batch_id", "part", "word"])
    return met.filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("id", "batch_id", "part")


def _shown(spark: SparkSession, path: str, before: int | None, folders: list) -> DataFrame:
    """The stored keys of the listed batches and parts."""
    fold = newest_fold(spark, path, "filters", before)
    keys = read_folded(spark, _KEYS, path, "ids", before, fold)
    parts: dict = {}
    for r in folders:
        parts.setdefault(r.batch_id, []).append(r.part)

    def among(listed: list[int]) -> Column:
        if len(listed) > SINGLE_PARTS:
            return F.col("part").isin(listed)
        return reduce(Column.__or__, (F.col("part") == p for p in listed))

    either = [(F.col("batch_id") == b) & among(p) for b, p in sorted(parts.items())]
    return keys.filter(reduce(Column.__or__, either, F.lit(False)))


def stored_among(items: DataFrame, path: str, before: int | None = None) -> DataFrame:
    """``id``: the keys of ``items`` that batches before ``before`` hold, each once and exactly."""
    spark = items.sparkSession
    shown = stored_once(possible(items, path, before), "possible")
    # at most PARTS rows a batch
    folders = shown.select("batch_id", "part").distinct().collect()
    return shown.join(_shown(spark, path, before, folders), ["id", "batch_id", "part"], "left_semi").select("id").distinct()


def absent(items: DataFrame, path: str, before: int | None = None) -> DataFrame:
    """The rows of ``items`` whose ``id`` no batch before ``before`` holds; rows without id stay."""
    if _nothing(path, before, items.sparkSession):
        return items
    return items.join(stored_among(items, path, before), "id", "left_anti")


def keys_read(items: DataFrame, path: str, before: int | None = None) -> DataFrame:
    """One row ``keys_read, keys_stored``: how many stored keys :func:`absent` compares, and how many there are."""
    spark = items.sparkSession
    folders = possible(items, path, before).select("batch_id", "part").distinct().collect()
    every = read_folded(spark, _KEYS, path, "ids", before, newest_fold(spark, path, "filters", before))
    read = _shown(spark, path, before, folders).agg(F.count(F.lit(1)).alias("keys_read"))
    return read.join(every.agg(F.count(F.lit(1)).alias("keys_stored")))
