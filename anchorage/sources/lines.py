"""Numbered lines of text files, and failing on the first line that breaks a rule."""

from __future__ import annotations

import contextlib
import gzip
import io
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorage.errors import InputError, ParseError, Unreadable

_NUMBERED = "path string, line_number long, value string"


def starts_with_gzip_magic(spark: SparkSession, path: str) -> bool:
    """The first two bytes decide, never the name.  Only these are read."""
    jvm = spark.sparkContext._jvm
    try:
        file = jvm.org.apache.hadoop.fs.Path(path)
        system = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stream = system.open(file)
        try:
            return (stream.read(), stream.read()) == (0x1F, 0x8B)
        finally:
            stream.close()
    except Exception as error:
        raise Unreadable("cannot read file", path) from error


class _Stream(io.RawIOBase):
    """Bytes of a stream on the JVM's side, a block at a time."""

    def __init__(self, stream):
        super().__init__()
        self._stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        data = bytes(self._stream.readNBytes(len(room)))
        room[: len(data)] = data
        return len(data)


@contextlib.contextmanager
def opened(spark: SparkSession, path: str, block: int = 1 << 16, start: int = 0) -> Iterator[io.BufferedReader]:
    """A file of any store that Spark reads, on the driver, from byte ``start``, of which no more is read than is asked for, in blocks."""
    jvm = spark.sparkContext._jvm
    try:
        file = jvm.org.apache.hadoop.fs.Path(path)
        stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    except Exception as error:
        raise Unreadable("cannot read file", path) from error
    try:
        if start:
            stream.seek(start)
        yield io.BufferedReader(_Stream(stream), block)
    finally:
        stream.close()


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_number, offset, bytes, value`` of a file that is not decompressed, read in splits.

    A line is what stands before a line feed, whatever its bytes; ``bytes``
    counts the line feed, ``offset`` the bytes before the line in the file.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", (F.octet_length("value") + 1).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size")
    )
    blocks = raw.groupBy("path", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("held"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    offsets = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines"), F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = F.coalesce(F.sum("bytes").over(Window.partitionBy("path", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = raw.withColumn("inside", inside).join(offsets, ["path", "block"]).withColumn("offset", F.col("start") + F.col("inside"))
    return placed.select(F.lit(path).alias("path"), (F.col("row") - F.col("first") + F.col("lines") + 1).alias("line_number"), "offset", F.least("bytes", F.col("size") - F.col("offset")).alias("bytes"), "value")


def under_headers(lines: DataFrame, header: Column) -> DataFrame:
    """``lines`` with ``header_line``, the number of the last line above or at each that is a header.

    The greatest within a block of lines, and from the blocks before it, of
    which there is one row each.
    """
    blocked = lines.withColumn("_block", F.floor(F.col("line_number") / 65536)).withColumn("_own", F.when(header, F.col("line_number")))
    blocks = blocked.groupBy("path", "_block").agg(F.max("_own").alias("_most"))
    before = blocks.select("path", "_block", F.max("_most").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = F.max("_own").over(Window.partitionBy("path", "_block").orderBy("line_number"))
    return blocked.withColumn("_inside", inside).join(before, ["path", "_block"]).withColumn("header_line", F.coalesce("_inside", "_before")).drop("_block", "_own", "_inside", "_before")


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a plain file, read in splits.

    Rows of a split keep their order, so a line's number is its place in the
    split plus the lines of the splits before it: one count per split.
    """
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("row"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    blocks = raw.groupBy("path", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.withColumn("before", before).drop("n")
    numbered = raw.join(offsets, ["path", "block"])
    return numbered.select(F.lit(path).alias("path"), (F.col("row") - F.col("first") + F.col("before") + 1).alias("line_number"), "value")


def _whole_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file whose name and content disagree on compression; universal line ends, unpacked as they are read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                packed = io.BytesIO(content.as_py())
                plain = gzip.GzipFile(fileobj=packed) if packed.getvalue()[:2] == b"\x1f\x8b" else packed
                lines = (line.removesuffix("\n") for line in io.TextIOWrapper(plain, "utf-8", "replace", newline=None))
                at = 0
                for part in itertools.batched(lines, 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(range(at + 1, at + len(part) + 1), pa.int64()), pa.array(part, pa.string())], names=["path", "line_number", "value"])
                    at += len(part)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _NUMBERED)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_number, value`` of a plain or gzip file.

    Spark unpacks files by their name, as they are read and of any size; where
    the first bytes say otherwise, a file is unpacked by one task that holds it.
    """
    return _split_lines(spark, path) if starts_with_gzip_magic(spark, path) == path.endswith(".gz") else _whole_file(spark, path)


def lines_of(spark: SparkSession, text: str, path: str = "<memory>") -> DataFrame:
    """Numbered lines of a text in hand."""
    found = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if found and not found[-1]:
        found.pop()
    return spark.createDataFrame([(path, i, v) for i, v in enumerate(found, 1)], _NUMBERED)


def first_of(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that is broken, else null.  A rule that can't be judged is not broken."""
    chain = None
    for broken, message in rules:
        test = F.coalesce(broken, F.lit(False))
        chain = F.when(test, message) if chain is None else chain.when(test, message)
    return chain


def fail_on_error(rows: DataFrame, kind: type[InputError] = ParseError) -> DataFrame:
    """Raise for the broken line with the least number; otherwise the rows without the ``error`` column."""
    bad = rows.where("error is not null").agg(F.min(F.struct("line_number", "error", "path")).alias("first")).first()["first"]
    if bad is not None:
        raise kind(bad["error"], bad["path"], bad["line_number"])
    return rows.drop("error")


def with_ordinal(rows: DataFrame) -> DataFrame:
    """Zero-based places in file order.

    Counted per block of lines and summed over blocks, so no task sees the
    whole file.
    """
    block = F.floor(F.col("line_number") / 65536)
    blocks = rows.groupBy("path", block.alias("_block")).agg(F.count(F.lit(1)).alias("_n"))
    before = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = rows.withColumn("_block", block).withColumn("_at", F.row_number().over(Window.partitionBy("path", "_block").orderBy("line_number")) - 1)
    return inside.join(before, ["path", "_block"]).withColumn("ordinal", (F.col("_before") + F.col("_at")).cast("long")).drop("_block", "_before", "_at")
