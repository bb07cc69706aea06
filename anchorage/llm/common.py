"""Shared helpers: reading tables, cutting lineage, deleting what was written."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import importlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.staging import written

#: Rows that a written step sends to a Python worker at a time.
BATCH = 1000


def quoted(column: str) -> str:
    """A column's name where an expression is read, whatever dots and quotes it holds."""
    return "`" + column.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine (driver or executor)."""
    return importlib.import_module("public_tokenizers").path(name)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return it read back.

    Lineage ends there, so losing an executor later costs a reread and not a
    recomputation, and every later use sees the same rows.
    """
    with _small_batches(df.sparkSession):
        return written(df, name)


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """For the jobs started here, send rows to Python workers ``BATCH`` at a time: whole texts are large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= BATCH:
        spark.conf.set(key, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ranges_for(df: DataFrame, each: int = 32 << 20) -> int:
    """Into how many ranges to deal ``df``: as many as there are shuffle partitions, and more where its input, by Spark's estimate, has over ``each`` bytes a range."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # without statistics the estimate is the greatest long
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // each))


def drop_scratch(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def releasing(rows: Iterator) -> Iterator:
    """``rows``; at their end the memory that a worker's tables took goes back to the system, as workers live on between tasks."""
    try:
        yield from rows
    finally:
        if hasattr(rows, "close"):
            rows.close()
        del rows
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
