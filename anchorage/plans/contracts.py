"""What each resource requires of an anchor, and what the anchor and the checks can say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.functions.digests import valid_md5
from anchorage.plans.model import BINDING, CAPABILITY, REQUIREMENT, digest, json_array, quoted, shaped


def _requirement(rows: DataFrame, prefix: str, resource: str, kind: str, label: str, named: Column, level: str = "mandatory", origin: str = "core_format", **columns) -> DataFrame:
    made = rows.select(digest(prefix, quoted(F.lit(label)), quoted(F.lit(resource)), quoted(named)).alias("requirement_id"), *[c.alias(k) for k, c in columns.items()])
    return shaped(made.withColumns({"resource_id": F.lit(resource), "kind": F.lit(kind), "level": F.lit(level), "origin": F.lit(origin)}), REQUIREMENT)


def variant_contract(resource: str, anchor: str, usage: DataFrame, contigs: DataFrame | None = None, count: DataFrame | None = None) -> DataFrame:
    """Presence of each used contig; its declared length and, if it is an MD5, digest; one requirement on the bases.

    ``usage``: ``sequence_name``; ``contigs``: ``name, length, md5``; ``count``: one row ``checked``.
    """
    name = F.col("sequence_name")
    out = _requirement(usage, "vcf-requirement", resource, "presence", "presence", name, sequence_name=name)
    if contigs is not None:
        used = contigs.join(usage.select(name.alias("name")), "name", "left_semi").withColumn("md5", valid_md5(F.col("md5")))
        known = used.where("md5 is not null")
        out = out.unionByName(_requirement(known, "vcf-requirement", resource, "identity", "identity", F.concat_ws(":", "name", "md5"), sequence_name=F.col("name"), scheme=F.lit("md5"), value=F.col("md5")))
        out = out.unionByName(_requirement(used.where("length is not null"), "vcf-requirement", resource, "length", "length", F.concat_ws(":", "name", F.col("length").cast("string")), sequence_name=F.col("name"), length=F.col("length")))
    if count is not None:
        out = out.unionByName(_requirement(count, "vcf-requirement", resource, "bases", "reference-bases", F.concat_ws(":", F.lit(anchor), F.col("checked").cast("string")), anchor_id=F.lit(anchor), count=F.col("checked")))
    return out


def alignment_contract(resource: str, dictionary: DataFrame) -> DataFrame:
    """Presence and length of each ``@SQ`` row, and its digest if it has one."""
    name = F.col("name")
    out = _requirement(dictionary, "alignment-requirement", resource, "presence", "presence", name, sequence_name=name)
    out = out.unionByName(_requirement(dictionary, "alignment-requirement", resource, "length", "length", F.concat_ws(":", "name", F.col("length").cast("string")), sequence_name=name, length=F.col("length")))
    known = dictionary.where("md5 is not null")
    return out.unionByName(_requirement(known, "alignment-requirement", resource, "identity", "identity", F.concat_ws(":", "name", "md5"), sequence_name=name, scheme=F.lit("md5"), value=F.col("md5")))


def annotation_contract(resource: str, anchor: str, usage: DataFrame, regions: DataFrame | None = None, embedded: DataFrame | None = None, count: DataFrame | None = None) -> DataFrame:
    """Presence of each used or declared sequence, identity of embedded ones, one requirement on the bounds."""
    names = usage.select("sequence_name")
    if regions is not None:
        names = names.unionByName(regions.select("sequence_name"))
    names = names.distinct()
    out = _requirement(names, "annotation-requirement", resource, "presence", "presence", F.col("sequence_name"), sequence_name=F.col("sequence_name"))
    if embedded is not None:
        own = embedded.join(names, "sequence_name", "left_semi")
        out = out.unionByName(_requirement(own, "annotation-requirement", resource, "identity", "embedded-identity", F.concat_ws(":", "sequence_name", "md5"), sequence_name=F.col("sequence_name"), scheme=F.lit("md5"), value=F.col("md5")))
    if count is not None:
        out = out.unionByName(_requirement(count, "annotation-requirement", resource, "bounds", "coordinate-bounds", F.concat_ws(":", F.lit(anchor), F.col("checked").cast("string")), anchor_id=F.lit(anchor), count=F.col("checked")))
    return out


def interval_contract(resource: str, anchor: str, usage: DataFrame, count: DataFrame) -> DataFrame:
    """Presence of each used name and one requirement on the bounds; nothing for an empty file."""
    out = _requirement(usage, "interval-requirement", resource, "presence", "presence", F.col("sequence_name"), sequence_name=F.col("sequence_name"))
    some = count.where("checked > 0")
    return out.unionByName(_requirement(some, "interval-requirement", resource, "bounds", "coordinate-bounds", F.concat_ws(":", F.lit(anchor), F.col("checked").cast("string")), anchor_id=F.lit(anchor), count=F.col("checked")))


def profile_contract(profile: str, database: str, anchor: str, presence: DataFrame) -> DataFrame:
    """One binding requirement per required name; mandatory if any requirement of the name is."""
    rows = presence.where("kind = 'presence'").groupBy("resource_id", "sequence_name").agg(F.bool_or(F.col("level") == "mandatory").alias("must"))
    made = rows.select(
        digest("profile-requirement", quoted(F.lit(profile)), quoted(F.lit(database)), quoted(F.lit(anchor)), quoted(F.col("resource_id")), quoted(F.col("sequence_name"))).alias("requirement_id"),
        "resource_id", F.lit("binding").alias("kind"), F.when(F.col("must"), "mandatory").otherwise("advisory").alias("level"), F.lit("profile").alias("origin"), "sequence_name", F.lit(anchor).alias("anchor_id"),
    )
    return shaped(made, REQUIREMENT)


def anchor_capabilities(anchor: str, sequences: DataFrame, with_order: bool = True) -> DataFrame:
    """What the anchor's snapshot shows of each sequence: presence, length, digests; and the order of all."""

    def row(kind: str, shown: Column, **columns) -> Column:
        base = {c: F.lit(None).cast(t) for c, t in CAPABILITY.items()}
        base |= {
            "capability_id": digest("anchor-capability", quoted(F.lit(anchor)), quoted(F.lit(kind)), quoted(F.col("name")), quoted(shown)), "kind": F.lit(kind), "resource_id": F.lit(anchor), "subject_id": F.lit(anchor),
            "sequence_name": F.col("name"), "provenance": F.lit("content_derived"), **columns,
        }
        return F.struct(*[c.cast(CAPABILITY[k]).alias(k) for k, c in base.items()])

    rows = [row("presence", F.lit("true"), present=F.lit(True)), F.when(F.col("length").isNotNull(), row("length", F.col("length").cast("string"), length=F.col("length")))]
    for scheme in ("md5", "refget"):
        if scheme in sequences.columns:
            rows.append(F.when(F.col(scheme).isNotNull(), row("identity", F.concat(F.lit(scheme + ":"), F.col(scheme)), scheme=F.lit(scheme), value=F.col(scheme))))
    out = sequences.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("c")).select("c.*")
    if not with_order:
        return out
    listed = sequences.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "name"))), lambda x: x["name"]).alias("names"))
    order = listed.select(
        digest("anchor-capability", quoted(F.lit(anchor)), quoted(F.lit("order")), quoted(F.lit("<collection>")), quoted(json_array(F.col("names")))).alias("capability_id"), F.lit("order").alias("kind"),
        F.lit(anchor).alias("resource_id"), F.lit(anchor).alias("subject_id"), "names",
    )
    return out.unionByName(shaped(order, CAPABILITY))


def check_capability(kind: str, subject: str, anchor: str, counts: DataFrame) -> DataFrame:
    """The result of an exhaustive check (``bases`` or ``bounds``): one row ``checked, conflict, unresolved``."""
    prefix = {"bases": "reference-base-capability", "bounds": "coordinate-bounds-capability"}[kind]
    numbers = [F.col(c).cast("string") for c in ("checked", "conflict", "unresolved")]
    made = counts.select(digest(prefix, quoted(F.lit(subject)), quoted(F.lit(anchor)), *numbers).alias("capability_id"), F.lit(kind).alias("kind"), F.lit(anchor).alias("resource_id"), F.lit(subject).alias("subject_id"), F.lit(anchor).alias("anchor_id"), "checked", "conflict", "unresolved")
    return shaped(made, CAPABILITY)


def absence_capabilities(resource: str, anchor: str, absent: DataFrame, local: DataFrame) -> DataFrame:
    """Names whose content is proven to be nowhere in the anchor, with the digests that prove it."""
    tokens = local.groupBy("local_name").agg(F.array_sort(F.collect_set(F.concat_ws(":", "scheme", "value"))).alias("tokens"))
    made = absent.join(tokens, "local_name").select(
        digest("sequence-identity-absence", quoted(F.lit(anchor)), quoted(F.lit(resource)), quoted(F.col("local_name")), F.array_join(F.transform("tokens", quoted), ",")).alias("capability_id"),
        F.lit("absence").alias("kind"), F.lit(anchor).alias("resource_id"), F.lit(resource).alias("subject_id"), F.col("local_name").alias("sequence_name"), F.lit(False).alias("present"), F.lit("content_derived").alias("provenance"),
    )
    return shaped(made, CAPABILITY)


def binding_table(resource: str, anchor: str, found: DataFrame) -> DataFrame:
    """Bindings with ids, of ``local_name, anchor_name, method, identity_values``."""
    values = F.coalesce("identity_values", F.array().cast("array<string>"))
    parts = [quoted(F.lit(resource)), quoted(F.col("local_name")), quoted(F.lit(anchor)), quoted(F.col("anchor_name"))]
    ident = F.when(F.size(values) > 0, digest("sequence-binding", *parts, F.array_join(F.transform(F.array_sort(values), quoted), ","))).otherwise(digest("sequence-binding", *parts))
    return shaped(found.withColumns({"binding_id": ident, "resource_id": F.lit(resource), "anchor_id": F.lit(anchor)}), BINDING)


def annotation_identities(resource: str, usage: DataFrame, embedded: DataFrame, supplied: DataFrame | None = None) -> DataFrame:
    """Identities that may bind an annotation's names: its embedded sequences, and content-derived ones that a caller supplies, of names it uses."""
    own = embedded.select(F.col("sequence_name").alias("local_name"), F.lit("md5").alias("scheme"), F.col("md5").alias("value"), F.lit("content_derived").alias("provenance"))
    if supplied is not None:
        own = own.unionByName(supplied.where("provenance = 'content_derived'").select("local_name", "scheme", "value", "provenance"))
    used = usage.select(F.col("sequence_name").alias("local_name")).distinct()
    return own.join(used, "local_name", "left_semi").distinct().withColumn("resource_id", F.lit(resource))
