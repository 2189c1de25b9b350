"""Batch and stream readers, and writers that can be repeated."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from pagetrawl import schemas


def _read(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages ``page_id, url, html``; ``spark.sql.files.maxPartitionBytes`` sets how many a task parses."""
    return _read(spark, schemas.RAW_PAGES, path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages, all batches."""
    return _read(spark, schemas.PAGES, path)


def read_backlinks(spark: SparkSession, path: str) -> DataFrame:
    """Stored links, all batches."""
    return _read(spark, schemas.BACKLINKS, path)


def stream_raw(spark: SparkSession, folder: str, glob: str = "*.parquet", files: int | None = None) -> DataFrame:
    """Raw pages as a stream over the files that arrive in ``folder``."""
    reader = spark.readStream.schema(schemas.RAW_PAGES).option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def stream_table(spark: SparkSession, schema: T.StructType, folder: str, glob: str = "*.parquet") -> DataFrame:
    """Any table as a stream over the files that arrive in ``folder``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """``df`` as batch ``batch`` of the table at ``path``; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def read_if_there(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame | None:
    """The table at ``path``, None if it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_batches(spark: SparkSession, schema: T.StructType, path: str, before: int | None = None,
                 keep_batch: bool = False) -> DataFrame:
    """A table written batch by batch, or its batches before ``before``.

    A table that does not exist yet is empty. The batch condition prunes folders.
    """
    batched = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    df = read_if_there(spark, batched, path)
    if df is None:
        return spark.createDataFrame([], batched if keep_batch else schema)
    if before is not None:
        df = df.filter(F.col("batch_id") < before)
    return df if keep_batch else df.drop("batch_id")
