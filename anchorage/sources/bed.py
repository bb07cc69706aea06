"""Interval files of 3 to 9 or 12 declared columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.errors import UnsupportedResource
from anchorage.operators.bounds import block_error, interval_usage
from anchorage.sources.lines import fail_on_error, first_of, numbered_lines, with_ordinal

LAYOUTS = {f"bed{n}": n for n in (3, 4, 5, 6, 7, 8, 9, 12)}
_LARGEST = "18446744073709551615"


def _u64(text: Column) -> Column:
    """Digits with any leading zeros up to 2**64 - 1, else null."""
    digits = F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", ""))
    value = F.when(F.length(digits) <= 20, F.try_to_number(digits, F.lit("9" * 20)).cast("decimal(20,0)"))
    return F.when(value <= F.lit(_LARGEST).cast("decimal(20,0)"), value)


def _integers(text: Column) -> Column:
    """A comma list with an optional trailing comma, else null."""
    plain = F.regexp_replace(text, ",$", "")
    return F.when(text.rlike("^[0-9]+(,[0-9]+)*,?$"), F.transform(F.split(plain, ","), _u64))


def parse(lines: DataFrame, layout: str) -> DataFrame:
    """Features with an ``error`` column; comments and blank lines are left out."""
    if layout not in LAYOUTS:
        raise UnsupportedResource(f"layout {layout!r} is not one of {', '.join(LAYOUTS)}")
    n = LAYOUTS[layout]
    value = F.col("value")
    rows = lines.where(~value.startswith("#") & (F.trim(value) != ""))
    tabs = F.split(value, "\t")
    rows = rows.withColumn("f", F.when(F.size(tabs) == n, tabs).otherwise(F.split(value, "[ \t]+")))

    def field(i: int) -> Column:
        return F.get("f", F.lit(i)) if i < n else F.lit(None).cast("string")

    def number(i: int) -> Column:
        return _u64(field(i)) if i < n else F.lit(None).cast("decimal(20,0)")

    start, end = number(1), number(2)
    none = F.lit(None).cast("array<decimal(20,0)>")
    rows = rows.select(
        "path", "line_number", value, "f", field(0).alias("chrom"), start.alias("start"), end.alias("end"), number(6).alias("thick_start"), number(7).alias("thick_end"),
        (_integers(field(10)) if n == 12 else none).alias("block_sizes"), (_integers(field(11)) if n == 12 else none).alias("block_starts"),
    )
    start, end, thick_start, thick_end = (F.col(c) for c in ("start", "end", "thick_start", "thick_end"))
    rules = [
        (value.rlike("[^\\x20-\\x7E\\t]"), "only printable ASCII is allowed"),
        (value.rlike("^(track|browser)(\\s|$)"), "track and browser lines are not allowed"),
        (value.rlike("^[ \t]|[ \t]$") & (F.size("f") != n), "leading or trailing blanks"),
        (F.size("f") != n, f"expected {n} fields"),
        (~F.coalesce(F.col("chrom").rlike("^[A-Za-z0-9_]{1,255}$"), F.lit(False)), "chrom must be 1 to 255 ASCII letters, digits or underscores"),
        (start.isNull(), "chromStart is not an unsigned 64-bit integer"),
        (end.isNull(), "chromEnd is not an unsigned 64-bit integer"),
        (start > end, "chromStart exceeds chromEnd"),
    ]
    if n >= 4:
        rules.append((~F.length(field(3)).between(1, 255), "name must have 1 to 255 characters"))
    if n >= 5:
        rules += [(number(4).isNull(), "score is not an unsigned integer"), (number(4) > 1000, "score exceeds 1000")]
    if n >= 6:
        rules.append((~field(5).isin("+", "-", "."), "strand must be +, - or ."))
    if n >= 7:
        rules += [(thick_start.isNull(), "thickStart is not an unsigned 64-bit integer"), (~thick_start.between(start, end), "thickStart lies outside the feature")]
    if n >= 8:
        rules += [(thick_end.isNull(), "thickEnd is not an unsigned 64-bit integer"), (~thick_end.between(thick_start, end), "thickEnd lies before thickStart or outside the feature")]
    if n >= 9:
        colour = F.split(field(8), ",")
        good = (field(8) == "0") | ((F.size(colour) == 3) & F.forall(colour, lambda c: F.coalesce(_u64(c) <= 255, F.lit(False))))
        rules.append((~good, "itemRgb must be 0 or three integers up to 255"))
    if n == 12:
        rules += [
            (number(9).isNull(), "blockCount is not an unsigned integer"),
            (F.col("block_sizes").isNull() | F.exists("block_sizes", lambda x: x.isNull()), "blockSizes is not a list of integers"),
            (F.col("block_starts").isNull() | F.exists("block_starts", lambda x: x.isNull()), "blockStarts is not a list of integers"),
        ]
    error = first_of(*rules)
    if n == 12:
        error = F.coalesce(error, block_error(end - start, number(9), F.col("block_sizes"), F.col("block_starts")))
    return rows.withColumn("error", error).select("path", "line_number", F.col("chrom").alias("sequence_name"), "start", "end", "thick_start", "thick_end", "block_sizes", "block_starts", "error")


def read(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Features in file order with an ``ordinal``; the first broken line raises."""
    return with_ordinal(fail_on_error(parse(numbered_lines(spark, path), layout)))


def context(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """The use of each sequence by a file of a declared layout, with that layout."""
    return interval_usage(read(spark, path, layout)).withColumn("layout", F.lit(layout))
