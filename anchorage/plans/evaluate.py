"""Requirements against capabilities: satisfied, unsatisfied, unresolved or not applicable.

Missing evidence is unresolved and never unsatisfied.  Candidates are found by
an equi-join on kind and key, in which both sides are shuffled but for orders;
every rule is one ``when`` chain over aggregates of a requirement's candidates,
of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.plans.model import BINDING, digest, json_array, quoted, shaped
from anchorage.staging import written


def _key(kind: Column, name: Column, scheme: Column, subject: Column, anchor: Column, count: Column) -> Column:
    return (
        F.when(kind == "identity", F.concat_ws("\x1f", name, scheme))
        .when(kind.isin("bounds", "bases"), F.concat_ws("\x1f", subject, anchor, count.cast("string")))
        .when(kind.isin("absence", "binding"), F.concat_ws("\x1f", subject, name))
        .when(kind == "order", F.lit("order"))
        .otherwise(name)
    )


def constraints(anchor: str, requirements: DataFrame, capabilities: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """One row per requirement with its candidates, its bindings and its state.

    A name is projected through a binding of its resource; without one it
    stands for itself; the names of an order one by one.  Identities answer only
    if they derive from content and use the same scheme; checks only if they
    cover the same pair and count; an order only if it has all projected names,
    and then the two lists must be the same.
    """
    spark = requirements.sparkSession
    bindings = shaped(bindings, BINDING) if bindings is not None else shaped(spark.createDataFrame([], "binding_id string"), BINDING)
    per_name = bindings.groupBy("resource_id", F.col("local_name").alias("sequence_name")).agg(F.min("anchor_name").alias("bound_name"), F.array_sort(F.collect_list("binding_id")).alias("named_bindings"))
    r = requirements.join(per_name, ["resource_id", "sequence_name"], "left")
    renames = F.col("bound_name").isNotNull() & (F.col("bound_name") != F.col("sequence_name"))
    r = r.withColumn("projected", F.coalesce("bound_name", "sequence_name")).withColumn("via_binding", renames)
    none = F.array().cast("array<string>")
    each = r.where("kind = 'order'").select("requirement_id", "resource_id", F.posexplode("names").alias("place", "sequence_name"))
    each = each.join(per_name, ["resource_id", "sequence_name"], "left").withColumn("named", F.coalesce("bound_name", "sequence_name"))
    listed = each.groupBy("requirement_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "named"))), lambda x: x["named"]).alias("projected_names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("bound_name") != F.col("sequence_name"), F.col("named_bindings")))))).alias("order_bindings"),
    )
    r = r.join(listed, "requirement_id", "left").withColumn("order_bindings", F.coalesce("order_bindings", none)).withColumn("via_binding", F.when(F.col("kind") == "order", F.size("order_bindings") > 0).otherwise(F.col("via_binding")))
    r = r.withColumn("binding_ids", F.when(F.col("kind") == "binding", F.coalesce("named_bindings", none)).when(F.col("kind") == "order", F.col("order_bindings")).when(F.col("kind").isin("bounds", "bases"), none).when(renames, F.col("named_bindings")).otherwise(none))
    name = F.when(F.col("kind") == "binding", F.col("sequence_name")).otherwise(F.col("projected"))
    r = r.withColumn("key", _key(F.col("kind"), name, F.col("scheme"), F.col("resource_id"), F.col("anchor_id"), F.col("count")))
    # Proven absence answers presence, by the requirement's own name.
    wanted = r.select("requirement_id", "kind", F.col("kind").alias("cap_kind"), "key").unionByName(
        r.where("kind = 'presence'").select("requirement_id", "kind", F.lit("absence").alias("cap_kind"), _key(F.lit("absence"), F.col("sequence_name"), F.lit(None), F.col("resource_id"), F.lit(None), F.lit(None)).alias("key"))
    )
    c = capabilities.where((F.col("kind") != "identity") | (F.col("provenance") == "content_derived")).select(
        F.col("kind").alias("cap_kind"), _key(F.col("kind"), F.col("sequence_name"), F.col("scheme"), F.col("subject_id"), F.col("anchor_id"), F.col("checked")).alias("key"),
        F.struct("capability_id", F.col("kind").alias("k"), "present", "length", "value", "checked", "conflict", "unresolved", "binding_state", "names").alias("c"),
    )
    # Capabilities are many times what Spark estimates from the compressed table they come from: broadcast, they could fill the driver.  Orders all have one key and few capabilities.
    order, on = F.col("cap_kind") == "order", ["cap_kind", "key"]
    pairs = wanted.where(~order).join(c.where(~order).hint("merge"), on).unionByName(wanted.where(order).join(c.where(order), on))
    found = pairs.groupBy("requirement_id").agg(F.array_sort(F.collect_list("c"), lambda a, b: F.when(a["capability_id"] < b["capability_id"], -1).when(a["capability_id"] > b["capability_id"], 1).otherwise(0)).alias("cands"))
    rows = r.join(found, "requirement_id", "left").withColumn("cands", F.coalesce("cands", F.array().cast("array<struct<capability_id:string,k:string,present:boolean,length:bigint,value:string,checked:bigint,conflict:bigint,unresolved:bigint,binding_state:string,names:array<string>>>")))
    fits = F.filter("cands", lambda x: F.size(F.array_except("projected_names", x["names"])) == 0)
    return _judged(anchor, rows.withColumn("cands", F.when(F.col("kind") == "order", fits).otherwise(F.col("cands"))))


def _ids(rows: Column) -> Column:
    return F.transform(rows, lambda x: x["capability_id"])


def _judged(anchor: str, rows: DataFrame) -> DataFrame:
    cands = F.col("cands")
    n = F.size(cands)

    def some(test) -> Column:
        return F.exists(cands, lambda x: F.coalesce(test(x), F.lit(False)))

    def values(field: str) -> Column:
        return F.array_distinct(F.transform(cands, lambda x: x[field]))

    absent = some(lambda x: x["k"] == "absence")
    presence = F.when(absent, "unsatisfied").when(n == 0, "unresolved").when(F.size(values("present")) > 1, "unresolved").when(F.get(values("present"), F.lit(0)), "satisfied").otherwise("unsatisfied")

    def exact(field: str, wanted: Column) -> Column:
        return F.when((n == 0) | (F.size(values(field)) != 1), "unresolved").when(F.get(values(field), F.lit(0)) == wanted, "satisfied").otherwise("unsatisfied")

    def of_check(x: Column) -> Column:
        return F.when(x["checked"] == 0, "not_applicable").when(x["conflict"] > 0, "unsatisfied").when(x["unresolved"] > 0, "unresolved").otherwise("satisfied")

    states = F.transform(cands, of_check)
    check = F.when(n == 0, "unresolved")
    for s in ("unsatisfied", "unresolved", "satisfied"):
        check = check.when(F.array_contains(states, s), s)
    check = check.otherwise("not_applicable")
    told = values("binding_state")
    binding = (
        F.when((n == 0) | (F.size(told) > 1), "unresolved").when(F.get(told, F.lit(0)).isin("content_conflict", "proven_absent"), "unsatisfied").when(F.size("binding_ids") == 1, "satisfied").otherwise("unresolved")
    )
    same = F.array_distinct(F.transform(cands, lambda x: x["names"] == F.col("projected_names")))
    order = F.when(F.size(same) != 1, "unresolved").when(F.get(same, F.lit(0)), "satisfied").otherwise("unsatisfied")
    kind = F.col("kind")
    state = (
        F.when(kind == "presence", presence).when(kind == "length", exact("length", F.col("length"))).when(kind == "identity", exact("value", F.col("value"))).when(kind == "binding", binding)
        .when(kind.isin("bounds", "bases"), check).when(kind == "order", order).otherwise(F.raise_error(F.lit("unknown requirement kind")))
    )
    mode = F.when(
        F.col("state") == "satisfied",
        F.when(kind == "identity", "verified_sequence_identity").when(kind == "binding", "verified_sequence_binding").when(kind.isin("bounds", "bases"), "exhaustive_direct").when(F.col("via_binding"), "verified_alias").otherwise("exact"),
    )
    nothing = F.array().cast("array<string>")
    deciding = F.filter(cands, lambda x: of_check(x) == F.col("state"))
    cited = (
        F.when(F.col("state") == "not_applicable", nothing)
        .when(kind.isin("bounds", "bases"), F.when(F.col("state") == "unresolved", nothing).otherwise(_ids(deciding)))
        .when((kind == "presence") & absent, _ids(F.filter(cands, lambda x: x["k"] == "absence")))
        .otherwise(_ids(cands))
    )
    made = rows.withColumn("candidate_ids", _ids(cands)).withColumn("state", state)
    made = made.withColumns({"mode": mode, "cited_ids": cited, "constraint_id": digest("constraint", quoted(F.lit(anchor)), quoted(F.col("requirement_id")), json_array(F.col("candidate_ids")), json_array(F.col("binding_ids")))})
    return made.select("constraint_id", "requirement_id", "resource_id", "kind", "level", "sequence_name", "projected", "candidate_ids", "binding_ids", "state", "mode", "cited_ids")


def reason(anchor: str, requirements: DataFrame, capabilities: DataFrame, bindings: DataFrame | None = None, excluded: int = 0, scoped: bool = False) -> dict[str, DataFrame]:
    """From requirements to a verdict: constraints, evidence, findings, verdict and conflict cores.

    Constraints and evidence are written once, as all that follows reads them.
    """
    from anchorage.plans import derive

    judged = written(constraints(anchor, requirements, capabilities, bindings), "constraints")
    evidence = written(derive.evidence(judged, capabilities), "evidence")
    findings = derive.findings(judged, evidence, anchor)
    verdict = derive.verdict(judged, findings, conditions=(excluded > 0) + scoped)
    return {"constraints": judged, "evidence": evidence, "findings": findings, "verdict": verdict, "cores": derive.conflict_cores(judged, findings, evidence)}
