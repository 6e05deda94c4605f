"""Helpers shared by the text operators: staging, guarded broadcasts, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a broadcast side may have (a few tens of MB of narrow rows).
BROADCAST_ROWS = 500_000
#: Bytes of a batch that a Python worker is sent.
BATCH_BYTES = "8m"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a local one, but never on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or _local_folder()).rstrip("/")


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="stages-")


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Python workers are sent some megabytes at a time, however long the texts of the rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: a lost executor costs only its own tasks."""
    spark = bounded_batches(df.sparkSession)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_not(df: DataFrame, sized_by: DataFrame | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size is proven small; else as it is, for a shuffled join.

    sized_by: what to count where a row of df holds a list, the list's elements.
    """
    return F.broadcast(df) if (sized_by or df).limit(rows + 1).count() <= rows else df


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def document_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns never meet an operator's own."""
    bounded_batches(docs.sparkSession)
    return docs.select(*[docs[n] for n in names])


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, Python workers are sent at most that many rows at a time: for rows that hold long lists."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
