"""Comparing collections of named sequences: differences, pairings, duplicates, relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return c.cast("string")


def differences(expected: DataFrame, observed: DataFrame, fields: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Differences of two collections keyed by ``name`` as ``kind, name, expected, observed``.

    A full outer join; each row of it yields a missing or extra name, or one
    difference per field that disagrees.  A field in ``optional`` is compared
    only where both sides have it.
    """
    e = expected.select("name", F.lit(True).alias("in_e"), *[F.col(f).alias(f"e_{f}") for f in fields])
    o = observed.select("name", F.lit(True).alias("in_o"), *[F.col(f).alias(f"o_{f}") for f in fields])
    both = e.join(o, "name", "full_outer")
    missing, extra = F.col("in_o").isNull(), F.col("in_e").isNull()
    none = F.lit(None).cast("string")

    def row(kind: str, wanted: Column, seen: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), _text(wanted).alias("expected"), _text(seen).alias("observed"))

    found = [F.when(missing, row("missing_sequence", F.col("name"), none)), F.when(extra, row("extra_sequence", none, F.col("name")))]
    for f in fields:
        x, y = F.col(f"e_{f}"), F.col(f"o_{f}")
        unlike = x.isNotNull() & y.isNotNull() & (x != y) if f in optional else ~x.eqNullSafe(y)
        kind = "m5_conflict" if f == "md5" else f
        found.append(F.when(~missing & ~extra & unlike, row(kind, x, y)))
    rows = both.select("name", F.explode(F.filter(F.array(*found), lambda d: d.isNotNull())).alias("d"))
    return rows.select("d.kind", "name", "d.expected", "d.observed")


def count_difference(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """A ``record_count`` difference, if there is one."""
    both = expected.select(F.lit(1).alias("e"), F.lit(0).alias("o")).unionByName(observed.select(F.lit(0).alias("e"), F.lit(1).alias("o")))
    n = both.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("e"), F.coalesce(F.sum("o"), F.lit(0)).alias("o"))
    return n.where("e <> o").select(F.lit("record_count").alias("kind"), F.lit(None).cast("string").alias("name"), _text(F.col("e")).alias("expected"), _text(F.col("o")).alias("observed"))


def order_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Names whose ordinal moved; only if both collections hold the same names."""
    both = expected.select("name", F.col("ordinal").alias("e")).join(observed.select("name", F.col("ordinal").alias("o")), "name", "full_outer")
    unequal = both.agg(F.coalesce(F.bool_or(F.col("e").isNull() | F.col("o").isNull()), F.lit(False)).alias("unequal"))
    moved = both.where("e <> o").select(F.lit("order").alias("kind"), "name", _text(F.col("e")).alias("expected"), _text(F.col("o")).alias("observed"))
    return moved.join(F.broadcast(unequal.where("not unequal")), F.lit(True), "left_semi")  # one row decides


def index_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """All differences of two FASTA indexes."""
    return count_difference(expected, observed).unionByName(differences(expected, observed, ["length", "offset", "line_bases", "line_bytes"])).unionByName(order_differences(expected, observed))


def dictionary_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """All differences of two sequence dictionaries; an absent MD5 is a gap and no difference."""
    return count_difference(expected, observed).unionByName(differences(expected, observed, ["length", "md5"], ("md5",))).unionByName(order_differences(expected, observed))


def dictionary_gaps(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Names in both collections whose observed MD5 is absent."""
    return observed.where(F.col("md5").isNull()).select("name").join(expected.select("name"), "name", "left_semi")


def unique_digests(table: DataFrame) -> DataFrame:
    """Rows whose md5 no other row has: grouped, not windowed, so no digest gathers its rows in one task."""
    once = table.where(F.col("md5").isNotNull()).groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"), F.min("length").alias("length"))
    return once.where("n = 1").drop("n")


def cross_name_pairs(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Missing and extra names that share a digest unique on both sides: ``md5, expected_name, observed_name, state``."""
    gone = unique_digests(expected).join(observed.select("name"), "name", "left_anti")
    new = unique_digests(observed).join(expected.select("name"), "name", "left_anti")
    pairs = gone.select("md5", F.col("name").alias("expected_name"), F.col("length").alias("e")).join(new.select("md5", F.col("name").alias("observed_name"), F.col("length").alias("o")), "md5")
    return pairs.select("md5", "expected_name", "observed_name", F.when(F.col("e") == F.col("o"), "match").otherwise("length_inconsistency").alias("state"))


def duplicates(table: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` found more than once, with their number."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def membership(anchor: DataFrame, other: DataFrame, key: str = "name") -> DataFrame:
    """How the names of ``other`` relate to the anchor's: one row with the counts and the relation."""
    a = anchor.select(key).distinct().withColumn("in_a", F.lit(1))
    o = other.select(key).distinct().withColumn("in_o", F.lit(1))
    n = a.join(o, key, "full_outer").agg(
        F.count_if(F.col("in_a").isNotNull() & F.col("in_o").isNotNull()).alias("n_both"), F.count_if(F.col("in_o").isNull()).alias("n_anchor_only"), F.count_if(F.col("in_a").isNull()).alias("n_other_only")
    )
    return n.withColumn("relation", membership_relation(F.col("n_both"), F.col("n_anchor_only"), F.col("n_other_only"), F.lit(False)))


def membership_relation(both: Column, anchor_only: Column, other_only: Column, unresolved: Column) -> Column:
    return (
        F.when(unresolved, "unresolved")
        .when((both == 0), "disjoint")
        .when((anchor_only == 0) & (other_only == 0), "exact")
        .when(other_only == 0, "alignment_subset")
        .when(anchor_only == 0, "alignment_superset")
        .otherwise("overlap")
    )


def same_order(anchor: DataFrame, other: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Whether the names that both hold stand in the same order, per ``group``.

    A group's shared names become one ordered array, as small as a collection's
    list of names.
    """
    group = group or []
    both = anchor.select(*group, "name", F.col("ordinal").alias("a")).join(other.select(*group, "name", F.col("ordinal").alias("o")), [*group, "name"])
    listed = both.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("a", "o"))).alias("l"))
    broken = F.exists(F.transform(F.col("l"), lambda x, i: x["o"] < F.get("l", i - 1)["o"]), lambda b: F.coalesce(b, F.lit(False)))
    return listed.select(*group, F.size("l").cast("long").alias("n_shared"), F.when(broken, "different").otherwise("consistent").alias("relation"))
