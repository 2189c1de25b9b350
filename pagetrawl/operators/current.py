"""A log of rows stored in buckets of their key, whose current rows are read without a shuffle.

The log keeps one folder per batch, like every table here, and each batch one
file per bucket. Spark reads a bucket of all batches in one task, so versions of a
row meet where they are stored: the newest is found among narrow columns and
its text goes straight from the file to the result. A lookup by key reads
one bucket.
"""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from pagetrawl.plans.skew import latest

#: Buckets of a new table. A bucket is a task's work, so about one per 500 MB of rows that the table will hold.
BUCKETS = 16


def _buckets(spark: SparkSession, path: str) -> int | None:
    """The buckets of the table at ``path``, fixed when it was begun; None if there is none."""
    try:
        return spark.read.schema("buckets int").json(f"{path}-layout").first().buckets
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _table(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> str:
    """The session's name for the table at ``path``."""
    name = f"pagetrawl_{hashlib.md5(path.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch_id BIGINT) USING parquet PARTITIONED BY (batch_id) "
                  f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def write_keyed(rows: DataFrame, path: str, batch: int, schema: T.StructType, key: str = "id",
                order: str = "indexed_time", buckets: int = BUCKETS) -> None:
    """``rows`` as batch ``batch`` of the keyed log at ``path``; a repeated batch replaces itself.

    Of rows with one key the newest by ``order`` is stored, of equally new ones that of the least hash.
    The rows of the batch move once, to their buckets. ``buckets`` counts when the table is begun.
    """
    spark = rows.sparkSession
    known = _buckets(spark, path)
    if known is None:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}-layout")
    name = _table(spark, path, schema, key, known or buckets)
    named = rows.select(*schema.fieldNames())
    once = latest(named, key, [F.desc(order), F.xxhash64(*named.columns)])
    view = f"{name}_rows"
    once.repartition(known or buckets, key).sortWithinPartitions(key).createOrReplaceTempView(view)
    spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION (batch_id = {int(batch)}) SELECT * FROM {view}")
    spark.catalog.dropTempView(view)


def keyed_log(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """All rows of the keyed log at ``path`` with their ``batch_id``; a table that does not exist yet is empty."""
    buckets = _buckets(spark, path)
    if buckets is None:
        return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())]))
    name = _table(spark, path, schema, key, buckets)
    spark.sql(f"MSCK REPAIR TABLE {name}")  # batches that other sessions wrote
    spark.catalog.refreshTable(name)
    return spark.table(name)


def newest(log: DataFrame, key: str = "id", order: str = "indexed_time") -> DataFrame:
    """The current row of every key: the newest by ``order``, of equally new ones that of the last batch.

    The newest version is taken from three narrow columns and met again on the key alone, by which the log is
    stored, so neither side is exchanged; the versions are the hashed side and the rows with text stream by.
    """
    version = F.struct(order, "batch_id")
    kept = log.groupBy(F.col(key).alias("_key")).agg(F.max(version).alias("_version")).hint("shuffle_hash")
    return log.join(kept, (F.col(key) == F.col("_key")) & (version >= F.col("_version"))).drop("_key", "_version", "batch_id")


def current_rows(spark: SparkSession, path: str, schema: T.StructType, key: str = "id", order: str = "indexed_time") -> DataFrame:
    """The current rows of the keyed log at ``path``."""
    return newest(keyed_log(spark, path, schema, key), key, order)


def lookup(spark: SparkSession, path: str, schema: T.StructType, ids: list[str], key: str = "id",
           order: str = "indexed_time") -> DataFrame:
    """The current rows of some keys: only the buckets that these keys fall into are read."""
    return newest(keyed_log(spark, path, schema, key).filter(F.col(key).isin(list(ids))), key, order)
