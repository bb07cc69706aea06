"""GTF and GFF3: features, directives, claims and embedded sequences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorage.errors import UnsupportedResource
from anchorage.functions.digests import normalized
from anchorage.operators.bounds import feature_usage
from anchorage.sources.lines import fail_on_error, first_of, numbered_lines, under_headers, with_ordinal

KINDS = ("gtf", "gff3")
# The bytes that a sequence id writes as they are, and the keys of claims.
_RAW = re.compile(r"(?:[A-Za-z0-9.:^*$@!+_?\-|]|%[0-9A-Fa-f]{2})+")
_PLAIN = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.:^*$@!+_?-|")
NCBI_KEYS = ("genome-build", "genome-build-accession", "annotation-date", "annotation-source")
GTF_KEYS = ("description", "provider", "date")
#: Coordinates longer than this are refused; that is this engine's limit.
DIGITS = 38
_DECODED = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])


def decode_seqid(raw: str) -> tuple[str | None, str | None]:
    """The decoded id, or what is wrong with it."""
    if not _RAW.fullmatch(raw):
        return None, "invalid escaping in a sequence id"
    data = bytearray()
    for part in re.findall(r"%..|[^%]+", raw):
        if part[0] == "%":
            byte = int(part[1:], 16)
            if byte in _PLAIN:
                return None, "a sequence id escapes a character that must not be escaped"
            data.append(byte)
        else:
            data += part.encode()
    try:
        return data.decode("utf-8"), None
    except UnicodeDecodeError:
        return None, "the escapes of a sequence id are not UTF-8"


@F.pandas_udf(_DECODED)
def _decoded(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_seqid(r) if isinstance(r, str) else (None, None) for r in raw], columns=["value", "error"])


def _seqid(raw: Column) -> tuple[Column, Column]:
    """Value and error.  Only ids with an escape leave the JVM."""
    plain = raw.rlike(r"^[A-Za-z0-9.:^*$@!+_?\-|]+$")
    slow = _decoded(F.when(~plain, raw))
    return F.when(plain, raw).otherwise(slow["value"]), F.when(~plain, slow["error"])


def _positive(text: Column) -> Column:
    digits = F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", ""))
    value = F.when(F.length(digits) <= DIGITS, digits).try_cast("decimal(38,0)")
    return F.when(value >= 1, value)


def _require(kind: str) -> None:
    if kind not in KINDS:
        raise UnsupportedResource(f"kind {kind!r} is not one of {', '.join(KINDS)}")


def fasta_boundary(lines: DataFrame, kind: str) -> DataFrame:
    """One row per path with an embedded sequence part: ``path, boundary, explicit``."""
    _require(kind)
    marks = lines.where((F.col("value") == "##FASTA") | F.col("value").startswith(">")) if kind == "gff3" else lines.where(F.lit(False))
    return marks.groupBy("path").agg(F.min("line_number").alias("boundary"), (F.min_by("value", "line_number") == "##FASTA").alias("explicit"))


def _above(lines: DataFrame, kind: str) -> DataFrame:
    if kind != "gff3":
        return lines
    return lines.join(fasta_boundary(lines, kind), "path", "left").where("boundary is null or line_number < boundary").drop("boundary", "explicit")


def parse_features(lines: DataFrame, kind: str) -> DataFrame:
    """Features with an ``error`` column."""
    _require(kind)
    value = F.col("value")
    skipped = (value == "") | value.startswith("#") | (~value.contains("\t") & (value.startswith("track ") | value.startswith("browser ")))
    rows = _above(lines, kind).where(~skipped).withColumn("f", F.split(value, "\t"))

    def field(i: int) -> Column:
        return F.get("f", F.lit(i))

    rows = rows.select("path", "line_number", "f", field(0).alias("raw_sequence_name"), field(2).alias("feature_type"), _positive(field(3)).alias("start"), _positive(field(4)).alias("end"), field(8).alias("attributes"))
    rules = [
        (F.size("f") != 9, "a feature has nine tab-separated fields"),
        (F.col("raw_sequence_name") == "", "the sequence id is empty"),
        (F.col("feature_type") == "", "the feature type is empty"),
    ]
    if kind == "gff3":
        name, wrong = _seqid(F.col("raw_sequence_name"))
        rows = rows.withColumn("sequence_name", name).withColumn("seqid_error", wrong)
        items = F.split("attributes", ";")
        flags = F.filter(items, lambda x: (x == "Is_circular") | x.startswith("Is_circular="))
        ids = F.transform(F.filter(items, lambda x: x.startswith("ID=")), lambda x: F.substring(x, 4, 1 << 30))
        rows = rows.withColumn("flags", flags).withColumn("ids", ids).withColumn("is_circular", F.coalesce((F.size("flags") == 1) & (F.get("flags", F.lit(0)) == "Is_circular=true"), F.lit(False)))
        rows = rows.withColumn("feature_id", F.when(F.col("is_circular"), F.url_decode(F.replace(F.get("ids", F.lit(0)), F.lit("+"), F.lit("%2B")))))
        rules += [
            (F.col("seqid_error").isNotNull(), "invalid sequence id"),
            (F.size("flags") > 1, "Is_circular appears twice"),
            ((F.size("flags") == 1) & (F.get("flags", F.lit(0)) != "Is_circular=true"), "Is_circular must be true"),
            (F.col("is_circular") & (F.size("ids") > 1), "ID appears twice"),
            (F.col("is_circular") & (F.get("ids", F.lit(0)) == ""), "ID is empty"),
        ]
    else:
        rows = rows.withColumn("sequence_name", F.col("raw_sequence_name")).withColumn("is_circular", F.lit(False)).withColumn("feature_id", F.lit(None).cast("string"))
    rules += [
        (F.col("start").isNull(), "start is not a positive integer"),
        (F.col("end").isNull(), "end is not a positive integer"),
        (F.col("start") > F.col("end"), "start exceeds end"),
    ]
    return rows.withColumn("error", first_of(*rules)).select("path", "line_number", "raw_sequence_name", "sequence_name", "feature_type", "start", "end", "is_circular", "feature_id", "error")


def features(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Features in file order; the first broken line raises."""
    return with_ordinal(fail_on_error(parse_features(numbered_lines(spark, path), kind)))


def parse_regions(lines: DataFrame) -> DataFrame:
    """``##sequence-region`` lines with an ``error`` column; a sequence may have one."""
    rows = _above(lines, "gff3").where("value = '##sequence-region' or value like '##sequence-region %'").withColumn("f", F.split(F.trim("value"), r"\s+"))
    name, wrong = _seqid(F.get("f", F.lit(1)))
    rows = rows.select("path", "line_number", F.size("f").alias("n"), name.alias("sequence_name"), wrong.alias("wrong"), _positive(F.get("f", F.lit(2))).alias("start"), _positive(F.get("f", F.lit(3))).alias("end"))
    first = rows.groupBy("path", "sequence_name").agg(F.min("line_number").alias("first"))
    rows = rows.join(first, ["path", "sequence_name"], "left")
    error = first_of(
        (F.col("n") != 4, "invalid sequence-region"),
        (F.col("wrong").isNotNull(), "invalid sequence id"),
        (F.col("start").isNull() | F.col("end").isNull(), "a sequence-region's bounds are positive integers"),
        (F.col("start") > F.col("end"), "sequence-region start exceeds end"),
        (F.col("line_number") > F.col("first"), "a sequence has two sequence-regions"),
    )
    return rows.withColumn("error", error).select("path", "line_number", "sequence_name", "start", "end", "error")


def versions(lines: DataFrame) -> DataFrame:
    """``##gff-version`` lines with an ``error`` column."""
    rows = _above(lines, "gff3").where("value = '##gff-version' or value like '##gff-version %'").withColumn("f", F.split(F.trim("value"), r"\s+"))
    good = (F.size("f") == 2) & F.get("f", F.lit(1)).rlike(r"^3(\.|$)")
    return rows.select("path", "line_number", F.get("f", F.lit(1)).alias("version"), F.when(~F.coalesce(good, F.lit(False)), "invalid gff-version").alias("error"))


def claims(lines: DataFrame, kind: str) -> DataFrame:
    """Provenance that a file claims: text only, never identity."""
    value = F.col("value")
    rows = _above(lines, kind)
    key = F.regexp_extract(value, r"^#!([^ ]*) ", 1)
    name = F.when(key.isin(*NCBI_KEYS), F.concat(F.lit("#!"), key))
    text = F.when(name.isNotNull(), F.regexp_replace(value, r"^#![^ ]* ", ""))
    if kind == "gff3":
        for k in ("##species", "##genome-build"):
            name = F.when(value.startswith(k + " "), k).otherwise(name)
            text = F.when(value.startswith(k + " "), F.substring(value, len(k) + 2, 1 << 30)).otherwise(text)
    else:
        own = F.lower(F.trim(F.regexp_extract(value, r"^##([^:]*):", 1)))
        name = F.when(own.isin(*GTF_KEYS), F.concat(F.lit("##"), own)).otherwise(name)
        text = F.when(own.isin(*GTF_KEYS), F.regexp_replace(value, r"^##[^:]*:", "")).otherwise(text)
    return rows.select("path", "line_number", name.alias("name"), F.trim(text).alias("value")).where("name is not null and value <> ''")


def embedded(lines: DataFrame) -> DataFrame:
    """Sequences behind the boundary: ``path, sequence_name, length, md5, line_number, error``."""
    below = lines.join(fasta_boundary(lines, "gff3"), "path").where("line_number >= boundary and value <> '##FASTA' and value <> ''")
    header = F.col("value").startswith(">")
    marked = under_headers(below, header)
    wrong = first_of((F.col("value").rlike("^[#;]"), "a comment in an embedded sequence"), (F.col("header_line").isNull(), "bases before the first header"), (~header & F.col("value").rlike("[^\\x00-\\x7F]"), "bases must be ASCII"))
    rows = marked.withColumn("wrong", wrong).groupBy("path", "header_line").agg(
        F.max(F.when(header, F.regexp_extract("value", r"^>\s*(\S*)", 1))).alias("sequence_name"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~header, F.struct("line_number", normalized(F.col("value")).alias("b"))))), lambda x: x["b"]), "").alias("bases"),
        F.min(F.when(F.col("wrong").isNotNull(), F.struct("line_number", "wrong"))).alias("bad"),
    )
    names = rows.groupBy("path", "sequence_name").agg(F.min("header_line").alias("first"))
    rows = rows.join(names, ["path", "sequence_name"], "left")
    error = F.coalesce(F.col("bad.wrong"), first_of((F.col("sequence_name") == "", "an embedded sequence has no name"), (F.col("bases") == "", "an embedded sequence is empty"), (F.col("header_line") > F.col("first"), "an embedded sequence appears twice")))
    return rows.select("path", F.coalesce("bad.line_number", "header_line").alias("line_number"), "sequence_name", F.length("bases").cast("long").alias("length"), F.md5(F.col("bases").cast("binary")).alias("md5"), error.alias("error"))


def context(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """All that a file says besides its single features: ``usage, regions, versions, claims, embedded``; the first broken line of any raises."""
    lines = numbered_lines(spark, path)
    found = {"usage": feature_usage(features(spark, path, kind)), "claims": claims(lines, kind)}
    if kind == "gff3":
        found |= {"regions": fail_on_error(parse_regions(lines)), "versions": fail_on_error(versions(lines)), "embedded": fail_on_error(embedded(lines))}
    return found
