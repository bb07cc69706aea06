"""Provider profiles: from required names over aliases and identities to bindings on the anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.operators.resolve import axis_collisions, identity_consistency, resolve_aliases, resolve_identities
from anchorage.plans.model import CAPABILITY, digest, quoted, shaped
from anchorage.sources.snapshot import Snapshot


def resolve_targets(snapshot: Snapshot, anchor: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Per canonical name: ``state, reason, anchor_name``.

    The provider's identities are looked for in the whole anchor; a match must
    also agree in length.  Without complete identity evidence, or without any
    identity, a name stays unresolved.
    """
    rows = snapshot.sequences.select(F.col("canonical_name").alias("local_name"), F.explode(F.array(F.struct(F.lit("md5").alias("scheme"), F.col("md5").alias("value")), F.struct(F.lit("refget").alias("scheme"), F.col("refget_id").alias("value")))).alias("i"))
    known = rows.select("local_name", "i.scheme", "i.value").where("value is not null")
    found = resolve_identities(known, anchor, selected).withColumnsRenamed({"local_name": "canonical_name", "state": "content", "anchor_name": "hit"})
    lengths = anchor.select(F.col("name").alias("hit"), F.col("length").alias("anchor_length"))
    joined = snapshot.sequences.join(found, "canonical_name", "left").join(lengths, "hit", "left")
    whole = F.lit(snapshot.completeness["content_identity"] == "complete")
    reason = (
        F.when(F.col("content").isNull() | ~whole, "content_identity_unavailable").when((F.col("content") == "matched") & (F.col("length") != F.col("anchor_length")), "provider_length_conflict").when(F.col("content") == "matched", "content_bound")
        .when(F.col("content") == "proven_absent", "exhaustive_content_absence").otherwise("content_identity_unresolved")
    )
    state = F.when(F.col("reason") == "content_bound", "bound").when(F.col("reason") == "exhaustive_content_absence", "proven_absent").otherwise("unresolved")
    out = joined.withColumn("reason", reason).withColumn("target_state", state)
    return out.select("canonical_name", "target_state", "reason", F.when(F.col("target_state") == "bound", F.col("hit")).alias("anchor_name"))


def project(snapshot: Snapshot | None, required: DataFrame, anchor_id: str, anchor: DataFrame, bindings: DataFrame, identities: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """What the profile says of each required name: one row with ``outcome``.

    ``required``: ``resource_id, local_name, mandatory``; ``bindings``:
    ``resource_id, local_name, anchor_name``; ``identities``: ``local_name,
    scheme, value``.  For a bound target, in this order: a binding to another
    sequence is a conflict; without a binding, identities that contradict the
    target, or a collision of targets, give nothing; otherwise a new binding,
    or the same one confirmed.  A target proven absent is absent; all else is
    unresolved.
    """
    if snapshot is None:
        return required.select("resource_id", "local_name", "mandatory", F.lit(None).cast("string").alias("canonical_name"), F.lit(None).cast("string").alias("anchor_name"), F.lit("provider_evidence_unavailable").alias("reason"), F.lit("unresolved").alias("outcome"))
    complete = snapshot.completeness
    names = resolve_aliases(required, snapshot.sequences, snapshot.aliases, complete["sequence_catalog"] == "complete", complete["aliases"] == "complete").select("local_name", F.col("reason").alias("name_reason"), "canonical_name")
    rows = required.join(names, "local_name").join(resolve_targets(snapshot, anchor, selected), "canonical_name", "left")
    blocked = axis_collisions(rows.where("target_state = 'bound'").select("anchor_name", "canonical_name", "mandatory"))
    rows = rows.join(blocked.select("anchor_name", "survivor", F.lit(True).alias("collides")), "anchor_name", "left")
    rows = rows.join(bindings.select("resource_id", "local_name", F.col("anchor_name").alias("bound_to")), ["resource_id", "local_name"], "left")
    consistent = identity_consistency(identities, anchor, rows.where("target_state = 'bound'").select("local_name", "anchor_name").distinct())
    rows = rows.join(consistent, ["local_name", "anchor_name"], "left")
    collides = F.coalesce("collides", F.lit(False)) & ~F.coalesce(F.col("survivor") == F.col("canonical_name"), F.lit(False))
    outcome = (
        F.when(F.col("target_state") == "proven_absent", "proven_absent").when(F.coalesce(F.col("target_state") != "bound", F.lit(True)), "unresolved").when(F.col("bound_to").isNotNull() & (F.col("bound_to") != F.col("anchor_name")), "content_conflict")
        .when(F.col("bound_to").isNull() & ~F.coalesce("consistent", F.lit(True)), "unresolved").when(collides, "unresolved").when(F.col("bound_to").isNull(), "new_binding").otherwise("bound")
    )
    return rows.select("resource_id", "local_name", "mandatory", "canonical_name", "anchor_name", F.coalesce(F.when(F.col("target_state").isNotNull(), F.col("reason")), F.col("name_reason")).alias("reason"), outcome.alias("outcome"))


def trace(projected: DataFrame, snapshot: Snapshot | None, bindings: DataFrame | None = None, validations: DataFrame | None = None) -> DataFrame:
    """How each required name came to its outcome, with the provider's sources behind its name and its content.

    ``bindings``: those of the bundle, with ``binding_id``; ``validations``:
    what :func:`capabilities` gave.
    """
    none = F.array().cast("array<string>")
    rows = projected
    if snapshot is None:
        rows = rows.withColumns({"name_sources": none, "content_sources": none})
    else:
        aliases = snapshot.aliases.groupBy(F.col("alias").alias("local_name"), "canonical_name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("alias_sources"))
        catalog = snapshot.sequences.select("canonical_name", F.array_sort("catalog_source_ids").alias("catalog_sources"), F.array_sort("identity_source_ids").alias("content_sources"))
        rows = rows.join(aliases, ["local_name", "canonical_name"], "left").join(catalog, "canonical_name", "left")
        named = F.when(F.col("local_name") == F.col("canonical_name"), F.col("catalog_sources")).otherwise(F.col("alias_sources"))
        rows = rows.withColumn("name_sources", F.coalesce(named, none)).withColumn("content_sources", F.coalesce("content_sources", none))
    for table, key, name in ((bindings, "binding_id", "local_name"), (validations, "capability_id", "sequence_name")):
        if table is None:
            rows = rows.withColumn(key, F.lit(None).cast("string"))
        else:
            owner = "resource_id" if key == "binding_id" else "subject_id"
            rows = rows.join(table.select(F.col(owner).alias("resource_id"), F.col(name).alias("local_name"), key), ["resource_id", "local_name"], "left")
    return rows.select("resource_id", "local_name", "mandatory", "canonical_name", "anchor_name", "reason", "outcome", "name_sources", "content_sources", "binding_id", "capability_id")


def context(snapshot: Snapshot | None, profile: str, target: str, traced: DataFrame) -> dict:
    """What a report says of a profile: its target, the provider's sources and completeness, and the trace of every name."""
    names = sorted((r.asDict() for r in traced.collect()), key=lambda r: (r["resource_id"], r["local_name"]))  # one row per required name
    out: dict = {"profile_id": profile, "target": target, "provider_context_id": None, "completeness": {}, "sources": [], "sequence_traces": names}
    if snapshot is not None:
        rows = sorted((r.asDict() for r in snapshot.sources.withColumn("acquired_at", F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ssXXX")).collect()), key=lambda r: r["id"])
        out |= {"provider_context_id": snapshot.context, "completeness": dict(sorted(snapshot.completeness.items())), "sources": rows}
    return out


def new_bindings(projected: DataFrame) -> DataFrame:
    """Bindings that the profile adds: ``resource_id, local_name, anchor_name, method``."""
    return projected.where("outcome = 'new_binding'").select("resource_id", "local_name", "anchor_name", F.lit("authoritative_name").alias("method"))


def capabilities(projected: DataFrame, snapshot: Snapshot, anchor_id: str) -> DataFrame:
    """Binding validations for the evaluator: bound, content conflict or proven absent."""
    state = F.when(F.col("outcome").isin("new_binding", "bound"), "bound").otherwise(F.col("outcome"))
    told = projected.where("outcome in ('new_binding', 'bound', 'content_conflict', 'proven_absent')").withColumn("binding_state", state)

    def part(c: Column) -> Column:
        return quoted(F.coalesce(c, F.lit("")))

    ident = digest("binding-validation", quoted(F.lit(snapshot.database)), quoted(F.lit(snapshot.context)), quoted(F.lit(anchor_id)), *(part(F.col(c)) for c in ("resource_id", "local_name", "canonical_name", "binding_state")))
    made = told.select(ident.alias("capability_id"), F.lit("binding").alias("kind"), F.lit(anchor_id).alias("resource_id"), F.col("resource_id").alias("subject_id"), F.col("local_name").alias("sequence_name"), "binding_state")
    return shaped(made, CAPABILITY)
