"""Reference bases of variant records against an anchor's bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.functions.digests import ascii_upper, reduced

#: Bases per chunk of a stored sequence.
CHUNK = 1 << 20
STATES = ("match", "mismatch", "out_of_bounds", "unresolved_sequence")


def check(records: DataFrame, bases: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """Adds ``state``, ``anchor_name`` and ``found`` (the anchor's bases where they differ).

    ``records``: ``sequence_name, position, ref``; ``bases``: ``name, sequence``.
    The bounds are tested first, as slices past an end are cut silently.  A
    position of 0 stands before the first base and is out of bounds.
    """
    target = F.col("sequence_name")
    rows = records
    if bindings is not None:
        named = bindings.select(F.col("local_name").alias("_local"), F.col("anchor_name").alias("_bound"))
        rows = rows.join(named, target == F.col("_local"), "left").withColumn("_target", F.coalesce("_bound", target)).drop("_local", "_bound")
    else:
        rows = rows.withColumn("_target", target)
    table = bases.select(F.col("name").alias("anchor_name"), F.col("sequence").alias("_bases"), F.length("sequence").alias("_length"))
    joined = rows.join(table, F.col("_target") == F.col("anchor_name"), "left")
    return _classified(joined, F.substring(F.col("_bases"), F.col("position").cast("int"), F.length("ref"))).drop("_target", "_bases", "_length", "_slice")


def _classified(joined: DataFrame, found: Column) -> DataFrame:
    end = F.col("position") - 1 + F.length("ref")
    state = (
        F.when(F.col("anchor_name").isNull(), "unresolved_sequence")
        .when((F.col("position") < 1) | (end > F.col("_length")), "out_of_bounds")
        .when(reduced(F.col("_slice")) == ascii_upper(F.col("ref")), "match")
        .otherwise("mismatch")
    )
    return joined.withColumn("_slice", found).withColumn("state", state).withColumn("found", F.when(F.col("state") == "mismatch", ascii_upper(F.col("_slice"))))


def chunked(bases: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``name, number, bases, length``: sequences in pieces, so that no task holds a chromosome."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("sequence") / chunk) - 1, F.lit(0))), lambda k: F.struct(k.cast("long").alias("number"), F.substring(F.col("sequence"), (k * chunk + 1).cast("int"), F.lit(chunk)).alias("bases")))
    return bases.select("name", F.length("sequence").cast("long").alias("length"), F.explode(pieces).alias("p")).select("name", "p.number", "p.bases", "length")


def check_chunked(records: DataFrame, chunks: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """:func:`check` against chunks, joined by name and chunk number.

    A record that reaches over a border is joined to each chunk it covers and
    put together again, equal records at once and as many times as there were;
    all others need one equi-join.
    """
    keyed = records.withColumn("_first", F.floor((F.col("position") - 1) / chunk)).withColumn("_last", F.floor((F.col("position") - 2 + F.greatest(F.length("ref"), F.lit(1))) / chunk))
    lengths = chunks.where("number = 0").select(F.col("name").alias("anchor_name"), F.col("length").alias("_length"))
    named = keyed.join(lengths, F.col("sequence_name") == F.col("anchor_name"), "left")
    single = named.where("_first = _last or anchor_name is null or position < 1 or position - 1 + length(ref) > _length")
    spread = named.where("_first < _last and anchor_name is not null and position >= 1 and position - 1 + length(ref) <= _length")
    pieces = chunks.select(F.col("name").alias("_name"), "number", "bases")
    one = single.join(pieces, (F.col("anchor_name") == F.col("_name")) & (F.col("_first") == F.col("number")), "left")
    one = _classified(one, F.substring(F.col("bases"), (F.col("position") - F.col("_first") * chunk).cast("int"), F.length("ref")))
    columns = [*records.columns, "anchor_name", "_length"]
    covered = spread.select(*columns, F.explode(F.sequence("_first", "_last")).alias("_k")).join(pieces, (F.col("anchor_name") == F.col("_name")) & (F.col("_k") == F.col("number")))
    low, high = F.greatest(F.col("position") - 1, F.col("_k") * chunk), F.least(F.col("position") - 1 + F.length("ref"), (F.col("_k") + 1) * chunk)
    part = F.substring(F.col("bases"), (low - F.col("_k") * chunk + 1).cast("int"), (high - low).cast("int"))
    whole = covered.withColumn("_opens", F.col("_k") == F.floor((F.col("position") - 1) / chunk)).groupBy(*columns).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_k", part.alias("part")))), lambda x: x["part"]), "").alias("_whole"), F.count_if("_opens").alias("_times")
    )
    many = _classified(whole.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))), F.col("_whole"))
    kept = [*records.columns, "anchor_name", "state", "found"]
    return one.select(*kept).unionByName(many.select(*kept))


def fetch(chunks: DataFrame, wanted: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Bases of zero-based half-open spans: ``wanted`` (``span_id, name, start, end``) with ``bases``, null outside a sequence.

    There is no random access into a file: spans meet the chunks that they
    cover in one equi-join by name and chunk number.
    """
    lengths = chunks.where("number = 0").select("name", "length")
    inside = wanted.join(lengths, "name", "left").withColumn("good", F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("length")), F.lit(False)))
    last = F.greatest(F.floor((F.col("end") - 1) / chunk), F.floor(F.col("start") / chunk))
    covered = inside.where("good").withColumn("number", F.explode(F.sequence(F.floor(F.col("start") / chunk), last)))
    low, high = F.greatest(F.col("start"), F.col("number") * chunk), F.least(F.col("end"), (F.col("number") + 1) * chunk)
    part = F.substring("bases", (low - F.col("number") * chunk + 1).cast("int"), (high - low).cast("int"))
    parts = covered.join(chunks.select("name", "number", "bases"), ["name", "number"], "left").groupBy("span_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.coalesce(part, F.lit("")).alias("part")))), lambda x: x["part"]), "").alias("bases")
    )
    return wanted.join(parts, "span_id", "left")


def outcomes(checked: DataFrame, by: str | None = "sequence_name") -> DataFrame:
    """Counts of each state, per sequence or in total."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    return checked.groupBy(by).agg(*counts) if by else checked.agg(*counts)


def problems(checked: DataFrame) -> DataFrame:
    """All records that do not match."""
    return checked.where("state <> 'match'")


def conflict_pattern(per_sequence: DataFrame) -> DataFrame:
    """One row that names how mismatches are spread over the sequences."""
    compared = (F.col("match") + F.col("mismatch")) > 0
    total = per_sequence.agg(
        F.coalesce(F.sum("match"), F.lit(0)).alias("n_match"),
        F.coalesce(F.sum("mismatch"), F.lit(0)).alias("n_mismatch"),
        F.coalesce(F.sum(F.col("out_of_bounds") + F.col("unresolved_sequence")), F.lit(0)).alias("n_unresolved"),
        F.count_if(compared).alias("n_compared_sequences"),
        F.count_if(F.col("mismatch") > 0).alias("n_affected_sequences"),
    )
    everywhere = (F.col("n_affected_sequences") == F.col("n_compared_sequences")) & (F.col("n_compared_sequences") >= 2)
    pattern = (
        F.when(F.col("n_unresolved") > 0, "unclassified")
        .when(F.col("n_mismatch") == 0, "none")
        .when(F.col("n_mismatch") == 1, "isolated")
        .when(everywhere & (F.col("n_match") == 0), "systematic")
        .when(everywhere, "distributed")
        .otherwise("localized")
    )
    return total.withColumn("pattern", pattern)


def capability(total: DataFrame) -> DataFrame:
    """Counts as the evaluator needs them: checked, mismatched, unresolved."""
    unresolved = F.col("out_of_bounds") + F.col("unresolved_sequence")
    return total.select((F.col("match") + F.col("mismatch") + unresolved).alias("checked"), F.col("mismatch").alias("conflict"), unresolved.alias("unresolved"))
