"""Coordinates of annotation and interval records against an anchor's lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.operators.resolve import resolve_names

FEATURE_STATES = ("representable", "circular_representable", "out_of_bounds", "unresolved_sequence", "circular_bounds_unresolved")
REGION_STATES = ("representable", "out_of_bounds", "unresolved_sequence")
INTERVAL_STATES = REGION_STATES


def landmarks(features: DataFrame, anchor: DataFrame, bindings: DataFrame | None = None, embedded: DataFrame | None = None) -> DataFrame:
    """Circular landmarks per sequence: ``sequence_name, landmark_length, established, error``.

    A landmark is the only circular ``region`` of its sequence, from 1 to the
    sequence's length.  It is established if the anchor's length is the same;
    more than one candidate, or one that starts elsewhere, gives no length.
    An embedded sequence of another length is an error.
    """
    candidates = features.where("is_circular and feature_type = 'region'").groupBy("sequence_name").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.min_by("end", "ordinal").alias("first_end"))
    usable = (F.col("n") == 1) & (F.col("first_start") == 1)
    rows = resolve_names(candidates, anchor, bindings).withColumn("landmark_length", F.when(usable, F.col("first_end")))
    if embedded is not None:
        rows = rows.join(embedded.select("sequence_name", F.col("length").alias("_embedded")), "sequence_name", "left")
    else:
        rows = rows.withColumn("_embedded", F.lit(None).cast("long"))
    wrong = F.coalesce(F.col("landmark_length") != F.col("_embedded"), F.lit(False))
    return rows.select("sequence_name", "landmark_length", F.coalesce(F.col("landmark_length") == F.col("anchor_length"), F.lit(False)).alias("established"), F.when(wrong, "embedded sequence and circular landmark differ in length").alias("error"))


def wrap_state(start: Column, end: Column, length: Column, established: Column) -> Column:
    """Of a feature of a circular sequence that ends beyond ``length``: representable, unresolved, invalid; ``none`` if it does not."""
    invalid = (start > length) | (end - length > length) | (end - length >= start)
    return F.when(length.isNull() | (end <= length), "none").when(invalid, "invalid").when(established, "representable").otherwise("unresolved")


def check_features(features: DataFrame, anchor: DataFrame, bindings: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Adds ``state`` and the wrap to one-based closed features."""
    rows = resolve_names(features, anchor, bindings)
    marks = landmarks(features, anchor, bindings) if marks is None else marks
    rows = rows.join(marks.select("sequence_name", "landmark_length", "established", F.lit(True).alias("has_landmark")), "sequence_name", "left")
    wrap = wrap_state(F.col("start"), F.col("end"), F.col("landmark_length"), F.coalesce("established", F.lit(False)))
    state = (
        F.when(F.col("anchor_length").isNull(), "unresolved_sequence")
        .when(F.col("wrap") == "representable", "circular_representable")
        .when(F.col("wrap").isin("unresolved", "invalid"), "circular_bounds_unresolved")
        .when(F.col("end") <= F.col("anchor_length"), "representable")
        .when(F.coalesce("has_landmark", F.lit(False)) & F.col("landmark_length").isNull(), "circular_bounds_unresolved")
        .otherwise("out_of_bounds")
    )
    return rows.withColumn("wrap", wrap).withColumn("state", state).drop("established", "has_landmark")


def feature_errors(checked: DataFrame, regions: DataFrame | None = None, embedded: DataFrame | None = None) -> DataFrame:
    """Features that break their own file: ``ordinal, line_number, error``; not conflicts with the anchor.

    In this order: a wrap that can't be, a feature outside the file's own
    region, one beyond the file's own sequence.  A possible wrap excuses the
    last two.
    """
    rows = checked
    if regions is not None:
        rows = rows.join(regions.select("sequence_name", F.col("start").alias("_from"), F.col("end").alias("_to")), "sequence_name", "left")
    else:
        rows = rows.withColumn("_from", F.lit(None).cast("long")).withColumn("_to", F.lit(None).cast("long"))
    if embedded is not None:
        rows = rows.join(embedded.select("sequence_name", F.col("length").alias("_own")), "sequence_name", "left")
    else:
        rows = rows.withColumn("_own", F.lit(None).cast("long"))
    straight = F.col("wrap") == "none"
    error = (
        F.when(F.col("wrap") == "invalid", "circular feature wraps more than once")
        .when(straight & ((F.col("start") < F.col("_from")) | (F.col("end") > F.col("_to"))), "feature lies outside its declared sequence-region")
        .when(straight & (F.col("end") > F.col("_own")), "feature lies beyond its embedded sequence")
    )
    return rows.withColumn("error", error).where("error is not null").select("ordinal", "line_number", "error")


def check_regions(regions: DataFrame, anchor: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """Adds ``state`` to declared sequence regions."""
    rows = resolve_names(regions, anchor, bindings)
    return rows.withColumn("state", F.when(F.col("anchor_length").isNull(), "unresolved_sequence").when(F.col("end") <= F.col("anchor_length"), "representable").otherwise("out_of_bounds"))


def check_intervals(intervals: DataFrame, anchor: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """Adds ``state`` to zero-based half-open intervals; an empty interval may stand at the end."""
    rows = resolve_names(intervals, anchor, bindings)
    inside = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("anchor_length"))
    return rows.withColumn("state", F.when(F.col("anchor_length").isNull(), "unresolved_sequence").when(inside, "representable").otherwise("out_of_bounds"))


def outcomes(checked: DataFrame, states: tuple[str, ...] = FEATURE_STATES, by: str | None = "sequence_name") -> DataFrame:
    """Counts of each state, per sequence or in total."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in states]
    return checked.groupBy(by).agg(*counts) if by else checked.agg(*counts)


def representatives(checked: DataFrame, order: str = "ordinal", good: tuple[str, ...] = ("representable", "circular_representable")) -> DataFrame:
    """The first problem of every sequence and state."""
    bad = checked.where(~F.col("state").isin(*good))
    fields = [c for c in checked.columns if c not in ("sequence_name", "state")]
    first = bad.groupBy("sequence_name", "state").agg(F.min_by(F.struct(*fields), order).alias("f"))
    return first.select("sequence_name", "state", "f.*")


def capability(features: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Feature and region outcomes folded to checked, conflict and unresolved."""
    rows = features.select("state")
    if regions is not None:
        rows = rows.unionByName(regions.select("state"))
    return rows.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(F.col("state") == "out_of_bounds").alias("conflict"), F.count_if(F.col("state").isin("unresolved_sequence", "circular_bounds_unresolved")).alias("unresolved")
    )


def block_error(span: Column, count: Column, sizes: Column, starts: Column) -> Column:
    """What is wrong with the blocks of a 12-column interval; null if nothing is."""
    n = F.size(sizes)
    ends = F.transform(F.arrays_zip(starts.alias("s"), sizes.alias("z")), lambda b: b["s"] + b["z"])
    overlap = F.exists(F.transform(starts, lambda s, i: F.coalesce(s < F.get(ends, i - 1), F.lit(False))), lambda x: x)
    return (
        F.when(count < 1, "block count must be positive")
        .when(count > span, "more blocks than bases")
        .when((n != count) | (F.size(starts) != count), "block lists and block count differ in length")
        .when(F.exists(sizes, lambda z: z < 1), "a block is empty")
        .when(F.get(starts, F.lit(0)) != 0, "the first block must start at 0")
        .when(F.exists(ends, lambda e: e > span), "a block reaches beyond the interval")
        .when(overlap, "blocks overlap or are out of order")
        .when(F.get(ends, n - 1) != span, "the last block must end with the interval")
    )


def usage(records: DataFrame, name: str = "sequence_name", order: str = "ordinal") -> DataFrame:
    """Per sequence, in order of first use: ``sequence_name, n_records, first_ordinal``."""
    return records.groupBy(F.col(name).alias("sequence_name")).agg(F.count(F.lit(1)).alias("n_records"), F.min(order).alias("first_ordinal"))


def interval_usage(records: DataFrame) -> DataFrame:
    return records.groupBy("sequence_name").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("start").alias("min_start"),
        F.max("end").alias("max_end"),
        F.min("ordinal").alias("first_ordinal"),
        F.min_by("line_number", "ordinal").alias("first_line"),
        F.count_if(F.col("start") == F.col("end")).alias("n_empty"),
    )


def feature_usage(records: DataFrame) -> DataFrame:
    circular, landmark = F.col("is_circular"), F.col("is_circular") & (F.col("feature_type") == "region")
    return records.groupBy("sequence_name").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("start").alias("min_start"),
        F.max("end").alias("max_end"),
        F.min("ordinal").alias("first_ordinal"),
        F.min_by("line_number", "ordinal").alias("first_line"),
        (F.count_distinct("raw_sequence_name") > 1).alias("many_spellings"),
        F.count_if(circular).alias("n_circular"),
        F.count_if(landmark).alias("n_landmarks"),
        F.min_by(F.when(landmark, F.struct("start", "end", "line_number")), F.when(landmark, F.col("ordinal"))).alias("landmark"),
    )
