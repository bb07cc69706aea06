"""A whole bundle: bindings and absences from content, supplements from profiles and checks, then the verdict.

The anchor is the caller's choice and no other resource outvotes it.  Content
identities of the others may bind their names to anchor sequences, or prove
that a sequence is nowhere in the anchor; validations of a profile or an
exhaustive check enter as supplements and only where a requirement asks for
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.errors import EvaluationError
from anchorage.operators.resolve import in_scope, resolve_identities, unknown_scope_names
from anchorage.plans import derive, evaluate
from anchorage.plans.contracts import anchor_capabilities
from anchorage.plans.model import BINDING, CAPABILITY, REQUIREMENT, digest, quoted, shaped
from anchorage.staging import written

_BREAK = "\x1f"
PAIR_KINDS = ("bounds", "bases", "binding")


def _keyed(identities: DataFrame) -> DataFrame:
    return identities.withColumn("local_name", F.concat_ws(_BREAK, "resource_id", "local_name"))


def _unkeyed(df: DataFrame) -> DataFrame:
    parts = F.split("local_name", _BREAK)
    return df.withColumn("resource_id", F.get(parts, F.lit(0))).withColumn("local_name", F.get(parts, F.lit(1)))


def _strings(values: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(values), quoted), ",")


def derived_bindings(anchor_id: str, anchor: DataFrame, identities: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Bindings of all resources at once, from ``resource_id, local_name, scheme, value``."""
    found = _unkeyed(resolve_identities(_keyed(identities), anchor, selected).where("state = 'matched'"))
    parts = [quoted(F.col("resource_id")), quoted(F.col("local_name")), quoted(F.lit(anchor_id)), quoted(F.col("anchor_name")), _strings(F.col("support"))]
    made = found.withColumns({"binding_id": digest("sequence-binding", *parts), "anchor_id": F.lit(anchor_id), "method": F.lit("verified_sequence_identity"), "identity_values": F.col("support")})
    return shaped(made, BINDING)


def derived_absences(anchor_id: str, anchor: DataFrame, identities: DataFrame, requirements: DataFrame) -> DataFrame:
    """Absence of names that a resource requires, where content proves it and no identity requirement of the same name shows it anyway."""
    content = identities.where("provenance = 'content_derived'")
    absent = _unkeyed(resolve_identities(_keyed(content), anchor).where("state = 'proven_absent'").select("local_name"))
    wanted = requirements.where("kind = 'presence'").select("resource_id", F.col("sequence_name").alias("local_name")).distinct()
    direct = requirements.where("kind = 'identity' and level = 'mandatory'").select("resource_id", F.col("sequence_name").alias("local_name")).distinct()
    direct = direct.join(anchor.select(F.col("name").alias("local_name")), "local_name", "left_semi")
    tokens = content.groupBy("resource_id", "local_name").agg(F.array_sort(F.collect_set(F.concat_ws(":", "scheme", "value"))).alias("tokens"))
    rows = absent.join(wanted, ["resource_id", "local_name"], "left_semi").join(direct, ["resource_id", "local_name"], "left_anti").join(tokens, ["resource_id", "local_name"])
    ident = digest("sequence-identity-absence", quoted(F.lit(anchor_id)), quoted(F.col("resource_id")), quoted(F.col("local_name")), _strings(F.col("tokens")))
    made = rows.select(ident.alias("capability_id"), F.lit("absence").alias("kind"), F.lit(anchor_id).alias("resource_id"), F.col("resource_id").alias("subject_id"), F.col("local_name").alias("sequence_name"), F.lit(False).alias("present"), F.lit("content_derived").alias("provenance"))
    return shaped(made, CAPABILITY)


def merged_bindings(derived: DataFrame, supplemental: DataFrame | None) -> DataFrame:
    """Derived ones win; a supplement for a new key is added, one for another target is an error."""
    if supplemental is None:
        return derived
    keys = ["resource_id", "local_name"]
    _refuse(supplemental.where("method <> 'authoritative_name'"), "a supplemental binding must be by authoritative name")
    _refuse(supplemental.join(derived.select(*keys, F.col("anchor_name").alias("found")), keys).where("found <> anchor_name"), "a supplemental binding contradicts content")
    return derived.unionByName(shaped(supplemental, BINDING).join(derived.select(*keys), keys, "left_anti"))


def _refuse(rows: DataFrame, message: str) -> None:
    if rows.head(1):
        raise EvaluationError(message)


def check_supplements(anchor_id: str, scope: list[str], requirements: DataFrame, capabilities: DataFrame, bindings: DataFrame, supplemental: DataFrame | None) -> None:
    """Every supplement is asked for, about a resource in scope, and fits the bindings."""
    _refuse(capabilities.where(~F.col("kind").isin(*PAIR_KINDS)), "supplements are validations of bases, bounds or bindings")
    _refuse(capabilities.groupBy("capability_id").count().where("count > 1"), "supplemental ids are not distinct")
    _refuse(capabilities.where(F.col("resource_id") != anchor_id), "supplements belong to the anchor")
    _refuse(capabilities.where(~F.col("subject_id").isin(*scope)), "supplements describe resources in scope")
    pairs = requirements.where(F.col("kind").isin(*PAIR_KINDS))
    _refuse(pairs.where(F.col("anchor_id") != anchor_id), "pair requirements name the anchor")
    checks = capabilities.where("kind <> 'binding'").join(pairs.select("kind", F.col("resource_id").alias("subject_id"), F.col("count").alias("checked")), ["kind", "subject_id", "checked"], "left_anti")
    _refuse(checks, "a supplement matches no requirement")
    told = capabilities.where("kind = 'binding'")
    _refuse(told.join(pairs.where("kind = 'binding'").select(F.col("resource_id").alias("subject_id"), "sequence_name"), ["subject_id", "sequence_name"], "left_anti"), "a supplement matches no requirement")
    bound = bindings.select(F.col("resource_id").alias("subject_id"), F.col("local_name").alias("sequence_name"), "method")
    states = told.join(bound, ["subject_id", "sequence_name"], "left")
    _refuse(states.where("binding_state = 'bound' and method is null"), "a bound validation needs its binding")
    _refuse(states.where("binding_state = 'content_conflict' and coalesce(method, '') <> 'verified_sequence_identity'"), "a content conflict needs a binding by content")
    if supplemental is not None:
        permits = told.where("binding_state = 'bound'").groupBy(F.col("subject_id").alias("resource_id"), F.col("sequence_name").alias("local_name")).agg(F.count(F.lit(1)).alias("n"))
        _refuse(supplemental.join(permits.where("n = 1"), ["resource_id", "local_name"], "left_anti"), "a supplemental binding needs one bound validation")


def reason_bundle(
    anchor_id: str,
    anchor: DataFrame,
    requirements: DataFrame,
    identities: DataFrame | None = None,
    supplements: DataFrame | None = None,
    supplemental_bindings: DataFrame | None = None,
    scope: list[str] | None = None,
    selected: DataFrame | None = None,
    excluded: int = 0,
) -> dict[str, DataFrame]:
    """Everything from requirements to conflict cores.

    ``anchor``: ``name, ordinal, length, md5, refget`` of the whole anchor;
    ``selected`` limits its names.  Requirements are those of the resources in
    ``scope``.  Returned are also the bindings and all capabilities, for the
    report.
    """
    spark = anchor.sparkSession
    if selected is not None:
        _refuse(unknown_scope_names(anchor, selected), "the scope names sequences that the anchor lacks")
    requirements = shaped(requirements, REQUIREMENT)
    if scope is not None:
        requirements = requirements.where(F.col("resource_id").isin(*scope))
    _refuse(requirements.groupBy("requirement_id").count().where("count > 1"), "requirement ids are not distinct")
    none = spark.createDataFrame([], "resource_id string, local_name string, scheme string, value string, provenance string")
    identities = none if identities is None else identities
    bindings = merged_bindings(derived_bindings(anchor_id, anchor, identities, selected), supplemental_bindings)
    named = in_scope(anchor, selected).where("in_scope").drop("in_scope")
    capabilities = anchor_capabilities(anchor_id, named).unionByName(derived_absences(anchor_id, anchor, identities, requirements))
    if supplements is not None:
        supplements = shaped(supplements, CAPABILITY)
        subjects = scope if scope is not None else [r[0] for r in requirements.select("resource_id").distinct().collect()]  # a bundle's resources
        check_supplements(anchor_id, subjects, requirements, supplements, bindings, supplemental_bindings)
        capabilities = capabilities.unionByName(supplements)
    judged = written(evaluate.constraints(anchor_id, requirements, capabilities, bindings), "constraints")
    evidence = written(derive.evidence(judged, capabilities), "evidence")
    findings = derive.findings(judged, evidence, anchor_id)
    verdict = derive.verdict(judged, findings, (excluded > 0) + (selected is not None))
    return {"constraints": judged, "evidence": evidence, "findings": findings, "verdict": verdict, "cores": derive.conflict_cores(judged, findings, evidence), "bindings": bindings, "capabilities": capabilities, "requirements": requirements}
