"""Resolving names and content identities against an anchor.

An anchor is a table ``name, ordinal, length, md5, refget``; a scope is a
selection of its names.  Uniqueness and completeness are always judged on the
whole anchor; the scope is applied last, so it can create neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMES = ("md5", "refget")


def in_scope(anchor: DataFrame, selected: DataFrame | None) -> DataFrame:
    """The anchor with a flag; all of it without a selection."""
    if selected is None:
        return anchor.withColumn("in_scope", F.lit(True))
    return anchor.join(selected.select("name").distinct().withColumn("in_scope", F.lit(True)), "name", "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(False)))


def unknown_scope_names(anchor: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected names that the anchor lacks: an input error if there is one."""
    return selected.select("name").join(anchor.select("name"), "name", "left_anti")


def resolve_names(records: DataFrame, anchor: DataFrame, bindings: DataFrame | None = None, name: str = "sequence_name") -> DataFrame:
    """Adds ``anchor_name`` and ``anchor_length``: by a binding if there is one, else by the same name, else null.

    ``bindings``: ``local_name, anchor_name``.  Both sides are the size of a
    sequence list; Spark broadcasts them while they are small and shuffles by
    name beyond that.
    """
    out = records
    if bindings is None:
        out = out.withColumn("_target", F.col(name))
    else:
        named = bindings.select(F.col("local_name").alias("_local"), F.col("anchor_name").alias("_bound"))
        out = out.join(named, F.col(name) == F.col("_local"), "left").withColumn("_target", F.coalesce("_bound", name)).drop("_local", "_bound")
    lengths = anchor.select(F.col("name").alias("anchor_name"), F.col("length").alias("anchor_length"))
    return out.join(lengths, F.col("_target") == F.col("anchor_name"), "left").drop("_target")


def anchor_identities(anchor: DataFrame) -> DataFrame:
    """``scheme, value, anchor_name, complete``: complete if every sequence of the whole anchor has the scheme."""
    complete = anchor.agg(*[(F.count(F.lit(1)) == F.count(s)).alias(s) for s in SCHEMES])
    rows = anchor.select(F.col("name").alias("anchor_name"), F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("value")) for s in SCHEMES])).alias("i"))
    flags = complete.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("complete")) for s in SCHEMES])).alias("c")).select("c.scheme", "c.complete")
    return rows.where("i.value is not null").select("anchor_name", "i.scheme", "i.value").join(F.broadcast(flags), "scheme")  # one row per scheme


def _schemes(anchor: DataFrame) -> DataFrame:
    flags = anchor.agg(*[((F.count(F.lit(1)) > 0) & (F.count(F.lit(1)) == F.count(s))).alias(s) for s in SCHEMES])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("complete")) for s in SCHEMES])).alias("c")).select("c.scheme", "c.complete")


def resolve_identities(local: DataFrame, anchor: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """What content identities say of each local name.

    ``local``: ``local_name, scheme, value``.  Result: ``local_name, state,
    anchor_name, support`` with state ``matched``, ``proven_absent`` or
    ``unresolved``; support lists the agreeing ``scheme:value``, sorted.

    In order: two values of one scheme leave it unresolved; one name found
    through complete schemes is a match, unless an identity also points to
    another name, contradicts the target in a shared scheme, or the target is
    out of scope; several names leave it unresolved, and so does a name found
    only through an incomplete scheme; an identity in a complete scheme that
    is found nowhere proves absence.
    """
    values = local.select("local_name", "scheme", "value").where("scheme is not null and value is not null").distinct()
    flagged = values.join(F.broadcast(_schemes(anchor)), "scheme", "left").withColumn("complete", F.coalesce("complete", F.lit(False)))
    index = anchor.select(F.col("name").alias("hit"), F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("value")) for s in SCHEMES])).alias("i")).select("hit", "i.scheme", "i.value").where("value is not null")
    # Per value: how many names have it and, if one, which.  A value of very many names stays one row.
    found = index.groupBy("scheme", "value").agg(F.count_distinct("hit").alias("names"), F.min("hit").alias("hit"))
    hits = flagged.join(found, ["scheme", "value"], "left")
    per = hits.groupBy("local_name").agg(
        (F.count(F.lit(1)) > F.count_distinct("scheme")).alias("two_values"),
        F.max(F.when(F.col("complete"), F.coalesce("names", F.lit(0)))).alias("most_complete"),
        F.min(F.when(F.col("complete"), F.col("hit"))).alias("lo"),
        F.max(F.when(F.col("complete"), F.col("hit"))).alias("hi"),
        F.coalesce(F.max("names"), F.lit(0)).alias("most"),
        F.min("hit").alias("any_lo"),
        F.max("hit").alias("any_hi"),
        F.bool_or("complete").alias("has_complete"),
        F.array_sort(F.collect_list(F.struct("scheme", "value"))).alias("values"),
    )
    target = in_scope(anchor, selected).select(F.col("name").alias("lo"), "in_scope", *[F.col(s).alias(f"target_{s}") for s in SCHEMES])
    joined = per.join(target, "lo", "left")

    def of_target(v: Column) -> Column:
        return F.coalesce(*[F.when(v["scheme"] == s, F.col(f"target_{s}")) for s in SCHEMES])

    contradicted = F.exists("values", lambda v: F.coalesce(of_target(v) != v["value"], F.lit(False)))
    one = (F.col("lo") == F.col("hi")) & (F.col("most_complete") == 1)
    clean = (F.col("most") == 1) & (F.col("any_lo") == F.col("any_hi")) & ~contradicted & F.col("in_scope")
    state = (
        F.when(F.col("two_values"), "unresolved")
        .when(F.col("lo").isNotNull() & one, F.when(clean, "matched").otherwise("unresolved"))
        .when(F.col("most") > 0, "unresolved")
        .when(F.col("has_complete"), "proven_absent")
        .otherwise("unresolved")
    )
    support = F.array_sort(F.transform(F.filter("values", lambda v: F.coalesce(of_target(v) == v["value"], F.lit(False))), lambda v: F.concat(v["scheme"], F.lit(":"), v["value"])))
    matched = F.col("state") == "matched"
    return joined.withColumn("state", state).select("local_name", "state", F.when(matched, F.col("lo")).alias("anchor_name"), F.when(matched, support).alias("support"))


def declared_bindings(declared: DataFrame, anchor: DataFrame, selected: DataFrame | None = None, need_length: bool = False, used: DataFrame | None = None) -> DataFrame:
    """Bindings that a header's MD5 allows: ``local_name, anchor_name, md5``.

    ``declared``: ``name, length, md5``.  Every anchor sequence must have an
    MD5; the target's must be unique in the whole anchor, the target in scope
    and named otherwise; lengths must agree where declared, and must be
    declared if ``need_length``.
    """
    known = anchor.agg((F.count(F.lit(1)) == F.count("md5")).alias("all_known"))
    unique = in_scope(anchor, selected).groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("anchor_name"), F.min("length").alias("anchor_length"), F.bool_and("in_scope").alias("in_scope")).where("n = 1 and in_scope")
    local = declared if used is None else declared.join(used.select(F.col("sequence_name").alias("name")).distinct(), "name", "left_semi")
    fits = F.col("length") == F.col("anchor_length")
    fits = F.coalesce(fits, F.lit(False)) if need_length else F.coalesce(fits, F.lit(True))
    found = local.where("md5 is not null").join(unique, "md5").where((F.col("name") != F.col("anchor_name")) & fits)
    return found.join(F.broadcast(known.where("all_known")), F.lit(True), "left_semi").select(F.col("name").alias("local_name"), "anchor_name", "md5")


def derive_bindings(local: DataFrame, anchor: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """One binding per local name whose identities match an anchor sequence."""
    return resolve_identities(local, anchor, selected).where("state = 'matched'").select("local_name", "anchor_name", F.lit("verified_sequence_identity").alias("method"), F.col("support").alias("identity_values"))


def identity_absences(local: DataFrame, anchor: DataFrame, required: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Required local names whose content is proven to be nowhere in the anchor.

    ``local`` also has ``provenance``; only content-derived identities count.
    ``required``: ``sequence_name``.  ``direct``: names with a mandatory
    identity requirement of the same name, where the conflict shows anyway if
    the anchor has that name.
    """
    content = local.where("provenance = 'content_derived'")
    absent = resolve_identities(content, anchor).where("state = 'proven_absent'").select("local_name")
    wanted = absent.join(required.select(F.col("sequence_name").alias("local_name")).distinct(), "local_name", "left_semi")
    if direct is None:
        return wanted
    shown = direct.select(F.col("sequence_name").alias("local_name")).join(anchor.select(F.col("name").alias("local_name")), "local_name", "left_semi")
    return wanted.join(shown, "local_name", "left_anti")


def identity_consistency(local: DataFrame, anchor: DataFrame, targets: DataFrame) -> DataFrame:
    """Per proposed naming (``local_name, anchor_name``) whether the identities of the name contradict it."""
    index = anchor.select(F.col("name").alias("anchor_name"), *[F.col(s).alias(f"target_{s}") for s in SCHEMES])
    rows = targets.join(index, "anchor_name", "left").join(local.select("local_name", "scheme", "value"), "local_name", "left")
    expected = F.coalesce(*[F.when(F.col("scheme") == s, F.col(f"target_{s}")) for s in SCHEMES])
    elsewhere = anchor.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(s).alias("value"), F.col("name").alias("other")) for s in SCHEMES])).alias("i")).select("i.*").where("value is not null")
    elsewhere = elsewhere.groupBy("scheme", "value").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    joined = rows.join(elsewhere, ["scheme", "value"], "left")
    wrong = F.coalesce(expected != F.col("value"), F.lit(False)) | F.coalesce((F.col("lo") != F.col("anchor_name")) | (F.col("hi") != F.col("anchor_name")), F.lit(False))
    return joined.groupBy("local_name", "anchor_name").agg((~F.bool_or(wrong)).alias("consistent"))


def merge_bindings(derived: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Derived bindings win; supplemental ones are added where their name is new."""
    return derived.unionByName(supplemental.join(derived.select("local_name"), "local_name", "left_anti"), allowMissingColumns=True)


def binding_conflicts(derived: DataFrame, supplemental: DataFrame) -> DataFrame:
    """Names that both bind, to different targets: an input error if there is one."""
    return supplemental.select("local_name", F.col("anchor_name").alias("given")).join(derived.select("local_name", "anchor_name"), "local_name").where("given <> anchor_name")


def resolve_aliases(names: DataFrame, catalog: DataFrame, aliases: DataFrame, catalog_complete: bool = True, aliases_complete: bool = True) -> DataFrame:
    """``local_name, state, method, reason, canonical_name``: the canonical name itself, else the one target of an alias.

    ``aliases``: ``alias, canonical_name``.  An alias counts only if catalog
    and aliases are complete, and only if it has exactly one target.
    """
    targets = aliases.groupBy("alias").agg(F.count_distinct("canonical_name").alias("targets"), F.min("canonical_name").alias("target"))
    canon = catalog.select(F.col("canonical_name").alias("canon")).distinct()
    rows = names.select("local_name").distinct().join(canon, F.col("local_name") == F.col("canon"), "left").join(targets, F.col("local_name") == F.col("alias"), "left")
    whole = F.lit(catalog_complete and aliases_complete)
    reason = (
        F.when(F.col("canon").isNotNull(), "canonical_name")
        .when(~whole, "alias_evidence_incomplete")
        .when(F.col("targets") > 1, "ambiguous_alias")
        .when(F.col("targets") == 1, "authoritative_alias")
        .otherwise("undeclared_name")
    )
    good = F.col("reason").isin("canonical_name", "authoritative_alias")
    return rows.withColumn("reason", reason).select(
        "local_name",
        F.when(good, "resolved").otherwise("unresolved").alias("state"),
        F.when(good, F.col("reason")).alias("method"),
        "reason",
        F.when(F.col("reason") == "canonical_name", F.col("canon")).when(F.col("reason") == "authoritative_alias", F.col("target")).alias("canonical_name"),
    )


def axis_collisions(resolved: DataFrame) -> DataFrame:
    """Blocked targets: ``anchor_name, n_targets, survivor``.

    ``resolved``: ``anchor_name, canonical_name, mandatory``.  Where two or
    more canonical names land on one anchor sequence all are blocked, except a
    sole mandatory one.
    """
    per = resolved.groupBy("anchor_name").agg(
        F.count_distinct("canonical_name").alias("n_targets"),
        F.count_distinct(F.when(F.col("mandatory"), F.col("canonical_name"))).alias("n_mandatory"),
        F.min(F.when(F.col("mandatory"), F.col("canonical_name"))).alias("sole"),
    )
    return per.where("n_targets >= 2").select("anchor_name", "n_targets", F.when(F.col("n_mandatory") == 1, F.col("sole")).alias("survivor"))
