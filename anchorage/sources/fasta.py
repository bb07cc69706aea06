"""FASTA: identities, bases, the index that fits the file, and index files."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.errors import FastaIndexError, IdentityError, ParseError, UnsupportedResource
from anchorage.functions.digests import collection_digests, normalized, refget_id, sequence_md5
from anchorage.operators.refbases import CHUNK
from anchorage.sources.lines import fail_on_error, first_of, numbered_lines, placed_lines, starts_with_gzip_magic, under_headers, with_ordinal
from anchorage.staging import written

GEOMETRY = ("length", "offset", "line_bases", "line_bytes")
_OTHER_BYTES = re.compile(rb"[^A-Za-z]+")


def _is_header() -> Column:
    return F.col("value").startswith(">")


def _headers(lines: DataFrame, marked: DataFrame) -> DataFrame:
    """``path, line_number, ordinal, name, error``, one row a header, and one for bases before the first."""
    rows = lines.where(_is_header()).select("path", "line_number", F.regexp_extract("value", r"^>(\S*)", 1).alias("name"))
    first = rows.groupBy("path", "name").agg(F.min("line_number").alias("first"))
    error = first_of((F.col("name") == "", "a sequence has no name"), (F.col("line_number") > F.col("first"), "a sequence name appears twice"))
    good = with_ordinal(rows.join(first, ["path", "name"]).withColumn("error", error)).select("path", "line_number", "ordinal", "name", "error")
    stray = marked.where("header_line is null").groupBy("path").agg(F.min("line_number").alias("line_number"))
    return good.unionByName(stray.withColumns({"ordinal": F.lit(None).cast("long"), "name": F.lit(None).cast("string"), "error": F.lit("bases before the first header")}))


def _marked(lines: DataFrame) -> DataFrame:
    return under_headers(lines.where("value <> ''"), _is_header()).where(~_is_header())


def sequences(lines: DataFrame) -> DataFrame:
    """``path, ordinal, name, sequence`` of numbered lines, with ``line_number`` and ``error``.

    A line belongs to the last header above it.  The bases of a sequence are
    put together in one cell, in line order; :func:`file_identities` and
    :func:`chunks` do without.
    """
    marked = _marked(lines)
    bases_of = marked.groupBy("path", F.col("header_line").alias("line_number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("line_number").alias("at"), "value"))), lambda x: x["value"]), "").alias("sequence"))
    return _headers(lines, marked).join(bases_of, ["path", "line_number"], "left").withColumn("sequence", F.coalesce("sequence", F.lit(""))).select("path", "line_number", "ordinal", "name", "sequence", "error")


def bases(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, name, sequence`` as the file has them; a file without a sequence is an error."""
    found = fail_on_error(sequences(numbered_lines(spark, path)))
    if not found.head(1):
        raise ParseError("no sequences", path)
    return found.select("ordinal", "name", "sequence")


def _streamed(lines: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of the lines of each sequence, which reach it one after the other and in order."""
    marked = _marked(lines).where("header_line is not null").select("header_line", "line_number", "value")
    return marked.repartition("header_line").sortWithinPartitions("header_line", "line_number").mapInArrow(run, schema)


def _checked_headers(spark: SparkSession, lines: DataFrame, path: str) -> DataFrame:
    heads = fail_on_error(written(_headers(lines, _marked(lines)), "headers"))
    if not heads.head(1):
        raise ParseError("no sequences", path)
    return heads.select(F.col("line_number").alias("header_line"), "ordinal", "name")


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """:func:`identities` of a file, digested line by line: no task holds a sequence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, length, md5, sha = None, 0, None, None

        def row() -> pa.RecordBatch:
            refget = "SQ." + base64.urlsafe_b64encode(sha.digest()[:24]).decode()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([length], pa.int64()), pa.array([md5.hexdigest()]), pa.array([refget])], names=["header_line", "length", "md5", "refget"])

        for batch in batches:
            for header, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if header != at:
                    if at is not None:
                        yield row()
                    at, length, md5, sha = header, 0, hashlib.md5(usedforsecurity=False), hashlib.sha512()
                data = _OTHER_BYTES.sub(b"", value.encode("utf-8", "surrogatepass")).upper()
                length += len(data)
                md5.update(data)
                sha.update(data)
        if at is not None:
            yield row()

    lines = numbered_lines(spark, path)
    heads = _checked_headers(spark, lines, path)
    found = _streamed(lines, run, "header_line long, length long, md5 string, refget string")
    empty = F.lit("")
    return heads.join(found, "header_line", "left").select(
        "ordinal", "name", F.coalesce("length", F.lit(0).cast("long")).alias("length"), F.coalesce("md5", sequence_md5(empty)).alias("md5"), F.coalesce("refget", refget_id(empty)).alias("refget")
    )


def chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """``name, number, bases, length`` of a file, cut as it is read: no task holds a sequence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, kept = None, 0, 0, []

        def row(text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([number], pa.int64()), pa.array([text])], names=["header_line", "number", "bases"])

        for batch in batches:
            for header, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if header != at:
                    if held:
                        yield row("".join(kept))
                    at, number, held, kept = header, 0, 0, []
                kept.append(value)
                held += len(value)
                if held >= chunk:
                    text = "".join(kept)
                    whole = held // chunk * chunk
                    for k in range(0, whole, chunk):
                        yield row(text[k : k + chunk])
                        number += 1
                    kept, held = [text[whole:]], held - whole
        if held:
            yield row("".join(kept))

    lines = numbered_lines(spark, path)
    heads = _checked_headers(spark, lines, path)
    pieces = written(_streamed(lines, run, "header_line long, number long, bases string"), "chunks")
    lengths = pieces.groupBy("header_line").agg(F.sum(F.length("bases")).cast("long").alias("length"))
    named = heads.select("header_line", "name").join(lengths, "header_line", "left").join(pieces, "header_line", "left")
    return named.select("name", F.coalesce("number", F.lit(0).cast("long")).alias("number"), F.coalesce("bases", F.lit("")).alias("bases"), F.coalesce("length", F.lit(0).cast("long")).alias("length"))


def identities(found: DataFrame) -> DataFrame:
    """``ordinal, name, length, md5, refget`` of ``ordinal, name, sequence``."""
    return found.select("ordinal", "name", F.length(normalized(F.col("sequence"))).cast("long").alias("length"), sequence_md5(F.col("sequence")).alias("md5"), refget_id(F.col("sequence")).alias("refget"))


def collection(identified: DataFrame) -> DataFrame:
    """One row: the digests of the whole collection, always complete."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "name", "length", "refget")))
    return identified.agg(rows.alias("r")).select(
        F.lit("complete").alias("completeness"), collection_digests(F.transform("r", lambda x: x["name"]), F.transform("r", lambda x: x["length"]), F.transform("r", lambda x: x["refget"])).alias("d")
    ).select("completeness", "d.*")


def geometry(lines: DataFrame) -> DataFrame:
    """``path, line_number, ordinal, name, length, offset, line_bases, line_bytes, error`` of placed lines.

    All lines of a sequence but its last are as long as its first, exactly if
    none is longer and they add up; everything else is a minimum, a maximum or
    a count, so a sequence is never brought together.
    """
    lines = lines.withColumn("value", F.regexp_replace("value", "\r+$", ""))
    size, held = F.octet_length("value").cast("long"), (F.col("value") != "") & ~_is_header()
    groups = under_headers(lines, _is_header()).groupBy("path", "header_line").agg(
        F.max(F.when(_is_header(), F.regexp_extract("value", r"^>\s*(\S*)", 1))).alias("name"),
        F.max(F.when(_is_header(), F.col("offset") + F.col("bytes"))).alias("offset"),
        F.min(F.when(held, F.struct("line_number", size.alias("bases"), "bytes"))).alias("first"),
        F.max(F.when(held, F.struct("line_number", size.alias("bases")))).alias("last"),
        F.count_if(held).alias("n"),
        F.coalesce(F.sum(F.when(held, size)), F.lit(0)).alias("length"),
        F.max(F.when(held, size)).alias("longest"),
        F.min(F.when(F.col("value") == "", F.col("line_number"))).alias("blank"),
    )
    groups = groups.where("header_line is not null or n > 0")
    full = F.col("first.bases")
    uneven = (F.col("longest") > full) | (F.col("length") - F.col("last.bases") != (F.col("n") - 1) * full) | (F.col("blank") < F.col("last.line_number"))
    name = F.concat(F.lit("'"), "name", F.lit("'"))
    error = F.when(F.col("header_line").isNull(), "bases before the first header").when(F.col("length") == 0, F.concat(F.lit("sequence "), name, F.lit(" is empty"))).when(uneven, F.concat(F.lit("lines of "), name, F.lit(" differ in length")))
    rows = groups.select("path", F.coalesce("header_line", F.lit(0).cast("long")).alias("line_number"), "name", "length", "offset", F.col("first.bases").alias("line_bases"), F.col("first.bytes").alias("line_bytes"), error.alias("error"))
    return with_ordinal(rows)


def expected_index(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, name, length, offset, line_bases, line_bytes`` that fits the file's bytes."""
    if starts_with_gzip_magic(spark, path):
        raise UnsupportedResource("compressed FASTA has no byte offsets", path)
    rows = fail_on_error(written(geometry(placed_lines(spark, path)), "geometry"), FastaIndexError)
    if not rows.head(1):
        raise FastaIndexError("no sequences", path)
    return rows.select("ordinal", "name", *GEOMETRY)


def parse_index(lines: DataFrame) -> DataFrame:
    """Rows of an index file with an ``error`` column."""
    f = F.split("value", "\t")
    numbers = {k: F.when(F.get(f, F.lit(i)).rlike("^[+-]?[0-9]+$"), F.get(f, F.lit(i))).try_cast("long").alias(k) for i, k in enumerate(GEOMETRY, 1)}
    rows = lines.select("path", "line_number", "value", F.size(f).alias("n"), F.get(f, F.lit(0)).alias("name"), *numbers.values())
    first = rows.groupBy("path", "name").agg(F.min("line_number").alias("first"))
    length, per, width = F.col("length"), F.col("line_bases"), F.col("line_bytes")
    error = first_of(
        (F.col("value") == "", "blank line"),
        (F.col("n") != 5, "an index line has five tab-separated fields"),
        (F.col("name") == "", "the sequence name is empty"),
        (F.col("name").rlike(r"\s"), "the sequence name holds white space"),
        (F.greatest(*[F.col(k).isNull().cast("int") for k in GEOMETRY]) == 1, "fields 2 to 5 are integers"),
        (F.least(*GEOMETRY) < 0, "a field is negative"),
        ((length > 0) & (per == 0), "a sequence has bases but no bases per line"),
        ((length > 0) & (per > length), "more bases per line than bases"),
        (width < per, "fewer bytes than bases per line"),
        ((length > per) & (width == per), "several lines need line ends"),
        (F.col("line_number") > F.col("first"), "a sequence name appears twice"),
    )
    return rows.join(first, ["path", "name"], "left").withColumn("error", error).select("path", "line_number", (F.col("line_number") - 1).alias("ordinal"), "name", *GEOMETRY, "error")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, name, length, offset, line_bases, line_bytes`` of an index file."""
    rows = fail_on_error(parse_index(numbered_lines(spark, path)))
    if not rows.head(1):
        raise ParseError("the index is empty", path)
    return rows.select("ordinal", "name", *GEOMETRY)


def expected_dictionary(identified: DataFrame) -> DataFrame:
    """``ordinal, name, length, md5`` of a complete snapshot; a gap or an empty sequence is an error."""
    bad = identified.where("length is null or length = 0 or md5 is null").orderBy("ordinal").head(1)
    if bad:
        raise IdentityError(f"sequence {bad[0]['name']!r} lacks a length or a digest")
    return identified.select("ordinal", "name", "length", "md5")
