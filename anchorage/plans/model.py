"""The wide tables that requirements, capabilities and constraints live in.

Closed vocabularies are strings; a column that a kind doesn't use is null.
Ids are SHA-256 digests of compact JSON, so the same facts have the same id in
every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIREMENT = {
    "requirement_id": "string", "resource_id": "string", "kind": "string", "level": "string", "origin": "string", "sequence_name": "string", "length": "long", "scheme": "string", "value": "string",
    "anchor_id": "string", "count": "long", "names": "array<string>",
}
CAPABILITY = {
    "capability_id": "string", "kind": "string", "resource_id": "string", "subject_id": "string", "sequence_name": "string", "present": "boolean", "length": "long", "scheme": "string", "value": "string",
    "provenance": "string", "anchor_id": "string", "checked": "long", "conflict": "long", "unresolved": "long", "binding_state": "string", "names": "array<string>",
}
BINDING = {"binding_id": "string", "resource_id": "string", "local_name": "string", "anchor_id": "string", "anchor_name": "string", "method": "string", "identity_values": "array<string>"}
RULES = {
    "presence": "sequence_presence", "length": "sequence_length", "identity": "sequence_identity", "order": "sequence_order", "bounds": "coordinate_bounds", "bases": "reference_bases", "binding": "sequence_binding",
}
CONFLICTS = {
    "presence": "missing_required_sequence", "length": "sequence_length_conflict", "identity": "sequence_identity_conflict", "order": "sequence_order_conflict", "bounds": "coordinate_bounds_conflict",
    "bases": "reference_base_conflict", "binding": "sequence_binding_conflict",
}


def shaped(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The columns of ``schema`` in order, null where ``df`` lacks one."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in schema.items()])


def quoted(c: Column) -> Column:
    """A JSON string of ASCII text."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def json_array(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ","), F.lit("]"))


def digest(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and the digest of ready JSON parts."""
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256))
