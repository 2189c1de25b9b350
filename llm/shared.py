"""Helpers of the operators: tables, stored intermediates, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of its own only on a local master."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local[app]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to a new folder of the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_held: dict = {}


def held(key: object, make: Callable):
    """The table that this worker process holds, made if it is of another key; only one is held at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts add up to about ``size`` bytes (one text at least)."""
    total, start = 0, 0
    for i, n in enumerate(byte_lengths(batch.column(column)).to_pylist()):
        if total and total + n > size:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def byte_lengths(column: pa.Array) -> pa.Array:
    """Bytes of each value; 0 for null."""
    return pc.fill_null(pc.cast(pc.binary_length(column), pa.int64()), 0)
