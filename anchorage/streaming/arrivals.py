"""Reference-base checks over variant files as they arrive.

A finite check needs no state: each record is judged by itself against the
anchor, so the stream is a stateless join with a static table and restarts
from its checkpoint without loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from anchorage.operators import refbases
from anchorage.sources.variants import parse_records


def arriving_records(spark: SparkSession, folder: str) -> DataFrame:
    """``sequence_name, position, ref, error`` of the text files that appear in a folder."""
    from pyspark.sql import functions as F

    lines = spark.readStream.format("text").schema("value string").load(folder)
    return parse_records(lines.select(F.lit(folder).alias("path"), F.lit(None).cast("long").alias("line_number"), "value"))


def check_arrivals(spark: SparkSession, folder: str, bases: DataFrame) -> DataFrame:
    """Each good record with its state; broken lines with theirs as ``invalid``."""
    from pyspark.sql import functions as F

    records = arriving_records(spark, folder)
    checked = refbases.check(records, bases)
    return checked.select("sequence_name", "position", "ref", F.when(F.col("error").isNotNull(), "invalid").otherwise(F.col("state")).alias("state"))


def write_outcomes(checked: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet, and stop when the folder is read."""
    return checked.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
