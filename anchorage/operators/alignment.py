"""How an alignment's dictionary relates to an anchor, and what to do with reference-dependent files offline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.operators.collections import membership_relation


def resolve_dictionary(dictionary: DataFrame, anchor: DataFrame, bindings: DataFrame | None = None, authoritative: DataFrame | None = None) -> DataFrame:
    """Per ``@SQ`` row: ``method`` and ``anchor_name``; by a binding, then the same name, else an extra or unresolved.

    A name that nothing resolves is a proven extra if its MD5 is known, every
    anchor MD5 is known and none equals it.
    """
    rows = dictionary.select("name", "ordinal", "length", "md5")
    pairs = None
    for table, method in ((authoritative, "authoritative_name_binding"), (bindings, "verified_m5_binding")):
        if table is not None:
            part = table.select(F.col("local_name").alias("name"), F.col("anchor_name").alias("bound"), F.lit(method).alias("bound_by"))
            pairs = part if pairs is None else pairs.unionByName(part.join(pairs.select("name"), "name", "left_anti"))
    rows = rows.join(pairs, "name", "left") if pairs is not None else rows.withColumn("bound", F.lit(None).cast("string")).withColumn("bound_by", F.lit(None).cast("string"))
    exact = anchor.select(F.col("name").alias("exact"))
    rows = rows.join(exact, F.col("name") == F.col("exact"), "left")
    digests = anchor.groupBy("md5").agg(F.lit(True).alias("known")).where("md5 is not null")
    every = anchor.agg((F.count(F.lit(1)) == F.count("md5")).alias("all_known"))
    rows = rows.join(digests, "md5", "left").crossJoin(F.broadcast(every))  # one row
    target = F.coalesce("bound", "exact")
    method = F.coalesce(F.col("bound_by"), F.when(F.col("exact").isNotNull(), "exact_name"), F.when(F.col("md5").isNotNull() & F.col("all_known") & F.col("known").isNull(), "distinct_extra"), F.lit("unresolved"))
    facts = anchor.select(F.col("name").alias("anchor_name"), F.col("ordinal").alias("anchor_ordinal"), F.col("length").alias("anchor_length"), F.col("md5").alias("anchor_md5"))
    return rows.withColumn("anchor_name", target).withColumn("method", method).select("name", "ordinal", "length", "md5", "method", "anchor_name").join(facts, "anchor_name", "left")


def duplicate_targets(resolved: DataFrame) -> DataFrame:
    """Anchor names that more than one dictionary row resolves to."""
    return resolved.where("anchor_name is not null").groupBy("anchor_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def relationship(resolved: DataFrame, anchor: DataFrame) -> DataFrame:
    """One row: membership, naming, order, content and the number of length conflicts."""
    hit = F.col("anchor_name").isNotNull()
    facts = resolved.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("anchor_name").alias("n_hit"),
        F.count_if(F.col("method") == "unresolved").alias("n_unresolved"),
        F.count_if(F.col("method") == "distinct_extra").alias("n_extra"),
        F.count_if(hit & (F.col("name") != F.col("anchor_name"))).alias("n_renamed"),
        F.count_if(hit & F.coalesce(F.col("length") != F.col("anchor_length"), F.lit(False))).alias("n_length_conflicts"),
        F.count_if(hit & F.coalesce(F.col("md5") != F.col("anchor_md5"), F.lit(False))).alias("n_md5_conflicts"),
        F.count_if(hit & (F.col("md5").isNull() | F.col("anchor_md5").isNull())).alias("n_md5_gaps"),
        F.array_sort(F.collect_list(F.when(hit, F.struct("ordinal", "anchor_ordinal")))).alias("order"),
        F.count(F.when(hit, F.lit(1))).alias("n_resolved"),
    )
    n = facts.crossJoin(anchor.agg(F.count(F.lit(1)).alias("n_anchor")))  # one row each
    doubled = F.col("n_resolved") > F.col("n_hit")
    moved = F.exists(F.transform("order", lambda x, i: F.coalesce(x["anchor_ordinal"] < F.get("order", i - 1)["anchor_ordinal"], F.lit(False))), lambda b: b)
    blocked = (F.col("n_unresolved") > 0) | doubled
    return n.select(
        membership_relation(F.col("n_hit"), F.col("n_anchor") - F.col("n_hit"), F.col("n_extra"), blocked).alias("membership"),
        F.when((F.col("n_unresolved") > 0) | (F.col("n_resolved") == 0), "unresolved").when(F.col("n_renamed") > 0, "verified_difference").otherwise("exact").alias("naming"),
        F.when(blocked | (F.col("n_resolved") == 0), "unresolved").when(moved, "different").otherwise("consistent").alias("order"),
        F.when(F.col("n_md5_conflicts") > 0, "m5_conflict").when((F.col("n_md5_gaps") > 0) | (F.col("n_unresolved") > 0) | (F.col("n_resolved") == 0), "unresolved").otherwise("m5_verified").alias("content"),
        F.col("n_length_conflicts"),
    )


def offline_reference(relation: DataFrame, readable: bool) -> DataFrame:
    """Whether the local anchor may serve a reference-compressed file without a network."""
    fits = F.col("membership").isin("exact", "alignment_subset") & (F.col("naming") == "exact") & (F.col("content") == "m5_verified") & (F.col("n_length_conflicts") == 0) & F.lit(readable)
    return relation.withColumn("action", F.when(fits, "use_explicit_local_anchor").otherwise("defer_reference_dependent_decoding"))
