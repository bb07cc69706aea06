"""From evaluated constraints to evidence, findings, a verdict and conflict cores."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.plans.model import CONFLICTS, RULES, digest, json_array, quoted

TIER_A, TIER_B = "tier_a_conclusive_content", "tier_b_direct_structural"


def _mapped(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])[c]


def evidence(judged: DataFrame, capabilities: DataFrame) -> DataFrame:
    """One row per capability that a decided constraint cites."""
    cited = judged.where("state in ('satisfied', 'unsatisfied')").select("constraint_id", "requirement_id", "kind", "state", "binding_ids", F.explode("cited_ids").alias("capability_id"))
    rows = cited.join(capabilities.select("capability_id", F.col("kind").alias("cap_kind"), "resource_id", "subject_id"), "capability_id")
    strong = F.col("kind").isin("identity", "bases") | (F.col("cap_kind") == "absence")
    method = (
        F.when(F.col("cap_kind") == "absence", "exhaustive_sequence_identity_absence").when(F.col("kind") == "bounds", "exhaustive_coordinate_bounds_validation").when(F.col("kind") == "bases", "exhaustive_reference_base_validation")
        .when((F.size("binding_ids") > 0) | (F.col("kind") == "binding"), "verified_sequence_binding").otherwise("exact_typed_constraint")
    )
    made = rows.select(
        "constraint_id", "requirement_id", "capability_id", "resource_id", "subject_id", F.when(F.col("cap_kind") == "absence", "sequence_identity").otherwise(_mapped(F.col("kind"), RULES)).alias("evidence_kind"), method.alias("method"),
        F.when(strong, TIER_A).otherwise(TIER_B).alias("strength"), F.when(F.col("state") == "satisfied", "supports").otherwise("contradicts").alias("polarity"), "binding_ids",
    )
    parts = [quoted(F.col(c)) for c in ("constraint_id", "requirement_id", "capability_id", "evidence_kind", "method", "strength", "polarity")]
    tail = F.array_join(F.transform(F.array_sort("binding_ids"), quoted), ",")
    ident = F.when(F.size("binding_ids") > 0, digest("evidence", *parts, tail)).otherwise(digest("evidence", *parts))
    return made.withColumn("evidence_id", ident)


def findings(judged: DataFrame, rows: DataFrame, anchor: str) -> DataFrame:
    """One row per constraint that is violated or can't be decided."""
    per = rows.groupBy("constraint_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))
    open_ = judged.where("state in ('unsatisfied', 'unresolved')").join(per, "constraint_id", "left")
    made = open_.select(
        F.when(F.col("state") == "unsatisfied", _mapped(F.col("kind"), CONFLICTS)).otherwise("unresolved_requirement").alias("finding_kind"), "constraint_id", "requirement_id", "level", "state",
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.array_sort(F.array_distinct(F.array(F.col("resource_id"), F.lit(anchor)))).alias("resource_ids"),
    )
    one = [json_array(F.array(F.col(c))) for c in ("constraint_id", "requirement_id")]
    return made.withColumn("finding_id", digest("finding", quoted(F.col("finding_kind")), *one, json_array(F.col("evidence_ids")), json_array(F.col("resource_ids"))))


def verdict(judged: DataFrame, found: DataFrame, conditions: int = 0) -> DataFrame:
    """One row.  Only mandatory requirements decide, and a conflict outweighs everything."""
    must = F.col("level") == "mandatory"
    n = judged.agg(*[F.count_if(must & (F.col("state") == s)).alias(f"n_{s}") for s in ("satisfied", "unsatisfied", "unresolved", "not_applicable")])
    value = (
        F.when(F.col("n_unsatisfied") > 0, "incompatible").when(F.col("n_unresolved") > 0, "indeterminate").when(F.col("n_satisfied") == 0, "indeterminate")
        .when(F.lit(conditions) > 0, "compatible_with_conditions").otherwise("compatible")
    )
    return n.withColumn("verdict", value)


def basis(found: DataFrame) -> DataFrame:
    """The findings that decide: mandatory conflicts if there are any, else mandatory open questions."""
    must = found.where("level = 'mandatory'")
    worst = must.agg(F.when(F.count_if(F.col("state") == "unsatisfied") > 0, "unsatisfied").otherwise("unresolved").alias("state"))
    return must.join(F.broadcast(worst), "state", "left_semi")  # one row


def conflict_cores(judged: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per deciding finding: the least set of facts that gives the verdict."""
    core = basis(found).withColumn("core_kind", F.when(F.col("state") == "unsatisfied", "contradiction").otherwise("unresolved"))
    lists = [json_array(F.array(F.col(c))) for c in ("constraint_id", "requirement_id", "finding_id")]
    ident = digest("conflict-core", quoted(F.col("core_kind")), *lists, json_array(F.col("evidence_ids")), json_array(F.col("resource_ids")))
    return core.select(ident.alias("core_id"), "core_kind", "finding_id", "constraint_id", "requirement_id", "evidence_ids", "resource_ids")


def conditions(scope: list[str], all_resources: list[str], anchor_names: list[str] | None, anchor: str, constraint_ids: list[str]) -> list[dict]:
    """Conditions that a limited scope puts on a positive verdict: at most two."""
    from anchorage.functions.digests import stable_id

    found = []
    left_out = sorted(set(all_resources) - set(scope))
    for kind, wanted in (("explicit_resource_scope", bool(left_out)), ("explicit_anchor_sequence_scope", anchor_names is not None)):
        if wanted:
            names = sorted(anchor_names) if anchor_names is not None else None
            excluded = left_out if kind == "explicit_resource_scope" else []
            found.append({"kind": kind, "condition_id": stable_id("condition", [kind, anchor, sorted(scope), names, sorted(constraint_ids), excluded]), "excluded": excluded, "anchor_names": names})
    return found
