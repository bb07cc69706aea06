"""Writing a step's rows down in the folder that all executors share, so that what follows reads them again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A URI that the driver and all executors see: the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset on a single machine, a temporary folder that goes when
    the program ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _holder
    if _holder is None:
        _holder = tempfile.TemporaryDirectory(prefix="anchorage-")
        atexit.register(_holder.cleanup)
    return Path(_holder.name).as_uri()


_holder: tempfile.TemporaryDirectory | None = None


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, below one folder per application, which may be deleted when that has ended."""
    return f"{shared_dir(spark)}/anchorage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: computed once, however often it is used, and never from its sources again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
