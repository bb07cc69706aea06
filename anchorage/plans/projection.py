"""One resource judged by itself: its contract, its bindings, its exhaustive check, and what follows.

The contract's facts come from one reading of the file (usage, declarations)
and the check from another.  Both must be about the same records and bindings;
a check that is stale, or of another file, is refused before anything is
concluded from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.errors import EvaluationError
from anchorage.operators import bounds, refbases
from anchorage.operators.resolve import declared_bindings
from anchorage.plans import bundle, contracts, evaluate
from anchorage.staging import written


def disagreements(usage: DataFrame, outcomes: DataFrame, states: tuple[str, ...], used: DataFrame | None = None, validated: DataFrame | None = None) -> DataFrame:
    """What two readings don't agree on: ``what, name, first, second``.

    ``usage``: ``sequence_name, n_records`` of the first reading; ``outcomes``:
    ``sequence_name`` and counts of ``states`` of the check.  ``used`` and
    ``validated``: the bindings (``local_name, anchor_name``) that the contract
    derives and those that the check went by.
    """

    def differing(what: str, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        both = a.withColumnRenamed("v", "first").join(b.withColumnRenamed("v", "second"), key, "full")
        return both.where(~F.col("first").eqNullSafe(F.col("second"))).select(F.lit(what).alias("what"), F.col(key).alias("name"), "first", "second")

    counts: Column = sum((F.col(s) for s in states[1:]), F.col(states[0]))
    found = differing("records", usage.select("sequence_name", F.col("n_records").cast("string").alias("v")), outcomes.select("sequence_name", counts.cast("string").alias("v")), "sequence_name")
    if used is not None or validated is not None:
        none = usage.sparkSession.createDataFrame([], "local_name string, anchor_name string")
        pairs = [(none if b is None else b).select("local_name", F.col("anchor_name").alias("v")) for b in (used, validated)]
        found = found.unionByName(differing("binding", *pairs, "local_name"))
    return found


def require_agreement(usage: DataFrame, outcomes: DataFrame, states: tuple[str, ...], used: DataFrame | None = None, validated: DataFrame | None = None) -> None:
    first = disagreements(usage, outcomes, states, used, validated).orderBy("what", "name").head(1)
    if first:
        r = first[0]
        raise EvaluationError(f"the check is not about these {r['what']}s: {r['name']!r} has {r['first']} and {r['second']}")


def variant_projection(
    resource: str,
    anchor_id: str,
    anchor: DataFrame,
    usage: DataFrame,
    contigs: DataFrame,
    outcomes: DataFrame,
    bindings: DataFrame | None = None,
    validated: DataFrame | None = None,
    selected: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """A variant file against an anchor.

    ``usage``: ``sequence_name, n_records``; ``contigs``: ``name, length, md5``
    as declared; ``outcomes``: counts of the base check by sequence, which went
    by the bindings ``validated``.  ``bindings`` replaces those that the
    declared digests allow, as where a profile names them.  Returned are all
    tables of a bundle, the bindings and the pattern of the mismatches.
    """
    outcomes = written(outcomes, "outcomes")
    if bindings is None:
        declared = contigs.select("name", "length", F.when(F.col("md5").rlike("^[0-9A-Fa-f]{32}$"), F.lower("md5")).alias("md5"))
        found = declared_bindings(declared, anchor, selected, used=usage)
        bindings = found.select("local_name", "anchor_name", F.lit("verified_sequence_identity").alias("method"), F.array(F.concat(F.lit("md5:"), "md5")).alias("identity_values"))
    bindings = written(contracts.binding_table(resource, anchor_id, bindings), "bindings")
    require_agreement(usage, outcomes, refbases.STATES, bindings, validated)
    count = refbases.capability(outcomes.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in refbases.STATES]))
    requirements = contracts.variant_contract(resource, anchor_id, usage, contigs, count)
    capabilities = contracts.anchor_capabilities(anchor_id, bundle.in_scope(anchor, selected).where("in_scope").drop("in_scope"), with_order=False).unionByName(contracts.check_capability("bases", resource, anchor_id, count))
    return evaluate.reason(anchor_id, requirements, capabilities, bindings, scoped=selected is not None) | {"bindings": bindings, "requirements": requirements, "capabilities": capabilities, "pattern": refbases.conflict_pattern(outcomes)}


def annotation_projection(
    resource: str,
    anchor_id: str,
    anchor: DataFrame,
    usage: DataFrame,
    outcomes: DataFrame,
    regions: DataFrame | None = None,
    embedded: DataFrame | None = None,
    supplied: DataFrame | None = None,
    validated: DataFrame | None = None,
    selected: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """An annotation against an anchor: as above, with bounds in place of bases, and names whose content is proven absent.

    ``outcomes`` counts features by sequence; ``regions`` are declared ones
    with their ``state``; ``embedded``: ``sequence_name, md5``; ``supplied``:
    identities that a caller vouches for.
    """
    spark = anchor.sparkSession
    outcomes = written(outcomes, "outcomes")
    own = embedded if embedded is not None else spark.createDataFrame([], "sequence_name string, md5 string")
    identities = written(contracts.annotation_identities(resource, usage, own, supplied), "identities")
    bindings = written(bundle.derived_bindings(anchor_id, anchor, identities, selected), "bindings")
    require_agreement(usage, outcomes, bounds.FEATURE_STATES, bindings, validated)
    total = [F.coalesce(F.sum(s), F.lit(0)) for s in bounds.FEATURE_STATES]
    by_state = dict(zip(bounds.FEATURE_STATES, total, strict=True))
    count = outcomes.agg(
        sum(total[1:], total[0]).alias("checked"), by_state["out_of_bounds"].alias("conflict"), (by_state["unresolved_sequence"] + by_state["circular_bounds_unresolved"]).alias("unresolved")
    )
    if regions is not None:
        extra = regions.agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("state") == "out_of_bounds").alias("o"), F.count_if(F.col("state") == "unresolved_sequence").alias("u"))
        count = count.crossJoin(extra).select((F.col("checked") + F.col("c")).alias("checked"), (F.col("conflict") + F.col("o")).alias("conflict"), (F.col("unresolved") + F.col("u")).alias("unresolved"))  # one row each
    requirements = contracts.annotation_contract(resource, anchor_id, usage, regions, embedded, count)
    capabilities = contracts.anchor_capabilities(anchor_id, bundle.in_scope(anchor, selected).where("in_scope").drop("in_scope"), with_order=False)
    capabilities = capabilities.unionByName(bundle.derived_absences(anchor_id, anchor, identities, requirements)).unionByName(contracts.check_capability("bounds", resource, anchor_id, count))
    return evaluate.reason(anchor_id, requirements, capabilities, bindings, scoped=selected is not None) | {"bindings": bindings, "requirements": requirements, "capabilities": capabilities}
