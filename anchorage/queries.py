"""Registered queries: every operator on virtual resources made of the driver's tables, and the same in SQL.

The anchor is ``documents``: sequence ``doc{doc_id}`` with the text as bases.
Line items stand for variant records and for intervals on it, other tables for
dictionaries, indexes, annotations, aliases and block lists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.functions.digests import refget_id, sequence_md5
from anchorage.operators import alignment, bounds, collections, refbases, resolve
from anchorage.plans import contracts, evaluate
from anchorage.plans.model import REQUIREMENT, shaped
from anchorage.staging import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The anchor.
_MD5 = "md5(upper(regexp_replace({}, '[^A-Za-z]', '', 'g')))"
_ANCHOR = f"anchor AS (SELECT 'doc' || doc_id AS name, doc_id AS ordinal, length(text) AS length, text AS sequence, {_MD5.format('text')} AS md5 FROM documents)"


def _anchor(spark: SparkSession, sf_dir: str, digests: bool = True) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    rows = d.select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("doc_id").alias("ordinal"), F.length("text").cast("long").alias("length"), F.col("text").alias("sequence"))
    if digests:
        rows = rows.withColumn("md5", sequence_md5(F.col("sequence"))).withColumn("refget", F.lit(None).cast("string"))
    return rows


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor without its bases: the texts are not read."""
    d = _table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("doc_id").alias("ordinal"), F.col("n_chars").alias("length"))


@query(f"SELECT 'doc' || doc_id AS name, doc_id AS ordinal, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))::BIGINT AS length, {_MD5.format('text')} AS md5 FROM documents")
def collection_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources.fasta import identities

    return identities(_anchor(spark, sf_dir, False)).select("name", "ordinal", "length", "md5")


@query()
def refget_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anchor(spark, sf_dir, False).select("name", refget_id(F.col("sequence")).alias("refget"))


@query()
def collection_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources.fasta import collection, identities

    return collection(identities(_anchor(spark, sf_dir, False)))


@query(f"WITH {_ANCHOR} SELECT md5, count(*)::BIGINT AS n FROM anchor GROUP BY md5 HAVING count(*) > 1")
def duplicate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.duplicates(_anchor(spark, sf_dir), "md5")


# A peer: the same texts under other names, every seventh of them changed, some without a digest or with another length.
_PEER = "peer AS (SELECT 'peer' || doc_id AS name, length(text) + CASE WHEN doc_id % 11 = 3 THEN 1 ELSE 0 END AS length, CASE WHEN doc_id % 13 = 5 THEN NULL ELSE {} END AS md5 FROM documents)".format(
    _MD5.format("CASE WHEN doc_id % 7 = 0 THEN text || 'changed' ELSE text END")
)


def _peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("changed"))).otherwise(F.col("text"))
    return d.select(
        F.concat(F.lit("peer"), "doc_id").alias("name"), (F.length("text") + F.when(F.col("doc_id") % 11 == 3, 1).otherwise(0)).cast("long").alias("length"), F.when(F.col("doc_id") % 13 != 5, sequence_md5(text)).alias("md5")
    )


@query(
    f"WITH {_ANCHOR}, {_PEER}, u AS (SELECT md5, min(name) AS name, min(length) AS length FROM anchor GROUP BY md5 HAVING count(*) = 1) "
    "SELECT peer.name AS local_name, u.name AS anchor_name, md5 FROM peer JOIN u USING (md5) WHERE peer.length = u.length"
)
def unique_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.declared_bindings(_peer(spark, sf_dir), _anchor(spark, sf_dir), need_length=True)


@query(
    f"WITH {_ANCHOR}, {_PEER}, p AS (SELECT md5, min(name) AS name, min(length) AS length FROM peer WHERE md5 IS NOT NULL GROUP BY md5 HAVING count(*) = 1), "
    "u AS (SELECT md5, min(name) AS name, min(length) AS length FROM anchor GROUP BY md5 HAVING count(*) = 1) "
    "SELECT md5, u.name AS expected_name, p.name AS observed_name, CASE WHEN u.length = p.length THEN 'match' ELSE 'length_inconsistency' END AS state FROM u JOIN p USING (md5)"
)
def cross_name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.cross_name_pairs(_anchor(spark, sf_dir), _peer(spark, sf_dir))


_LOCAL = (
    f"loc AS (SELECT 'doc' || doc_id AS local_name, {_MD5.format('text')} AS value FROM documents UNION ALL SELECT 'item' || item_id, {_MD5.format('text')} FROM benchmark "
    f"UNION ALL SELECT 'doc' || doc_id, {_MD5.format(chr(39) + 'other' + chr(39) + ' || text')} FROM documents WHERE doc_id % 11 = 0)"
)


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    rows = d.select(F.concat(F.lit("doc"), "doc_id").alias("local_name"), sequence_md5(F.col("text")).alias("value")).unionByName(b.select(F.concat(F.lit("item"), "item_id").alias("local_name"), sequence_md5(F.col("text")).alias("value")))
    rows = rows.unionByName(d.where("doc_id % 11 = 0").select(F.concat(F.lit("doc"), "doc_id").alias("local_name"), sequence_md5(F.concat(F.lit("other"), "text")).alias("value")))
    return rows.withColumn("scheme", F.lit("md5")).withColumn("provenance", F.lit("content_derived"))


_STATES = (
    f"WITH {_ANCHOR}, {_LOCAL}, a AS (SELECT md5 AS value, count(*) AS n, min(name) AS name FROM anchor GROUP BY md5), "
    "g AS (SELECT local_name, count(DISTINCT value) AS n_values, max(coalesce(n, 0)) AS n, min(a.name) AS name FROM loc LEFT JOIN a USING (value) GROUP BY local_name), "
    "s AS (SELECT local_name, CASE WHEN n_values > 1 THEN 'unresolved' WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'unresolved' ELSE 'proven_absent' END AS state, name FROM g) "
)


@query(_STATES + "SELECT local_name, state, CASE WHEN state = 'matched' THEN name END AS anchor_name FROM s")
def identity_resolution_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_identities(_local(spark, sf_dir), _anchor(spark, sf_dir)).drop("support")


@query(_STATES + "SELECT local_name FROM s WHERE state = 'proven_absent' AND local_name IN (SELECT 'item' || item_id FROM benchmark)")
def identity_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), "item_id").alias("sequence_name"))
    return resolve.identity_absences(_local(spark, sf_dir), _anchor(spark, sf_dir), wanted)


@query(_STATES + "SELECT local_name, name AS anchor_name, 'verified_sequence_identity' AS method FROM s WHERE state = 'matched'")
def derived_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.derive_bindings(_local(spark, sf_dir), _anchor(spark, sf_dir)).select("local_name", "anchor_name", "method")


@query(
    _STATES + "SELECT local_name AS sequence_name, CASE WHEN state = 'proven_absent' THEN 'unsatisfied' WHEN state = 'matched' OR local_name LIKE 'doc%' THEN 'satisfied' ELSE 'unresolved' END AS state, "
    "CASE WHEN state = 'matched' THEN CASE WHEN name <> local_name THEN 'verified_alias' ELSE 'exact' END WHEN state = 'unresolved' AND local_name LIKE 'doc%' THEN 'exact' END AS mode FROM s"
)
def bundle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole bundle whose content identities bind names to the anchor or prove them absent."""
    from anchorage.plans import bundle

    local = written(_local(spark, sf_dir).withColumn("resource_id", F.lit("peer")).withColumn("provenance", F.lit("content_derived")), "identities")
    names = local.select("local_name").distinct()
    requirements = names.select(F.concat(F.lit("need "), "local_name").alias("requirement_id"), F.lit("peer").alias("resource_id"), F.lit("presence").alias("kind"), F.lit("mandatory").alias("level"), F.col("local_name").alias("sequence_name"))
    anchor = written(_anchor(spark, sf_dir).drop("sequence"), "anchor")
    return bundle.reason_bundle("documents", anchor, shaped(requirements, REQUIREMENT), local)["constraints"].select("sequence_name", "state", "mode")


# Dictionaries and indexes.
_DICTS = (
    "WITH e AS (SELECT 'part' || p_partkey AS name, p_partkey AS ordinal, p_size::BIGINT AS length, md5(p_name) AS md5 FROM part), "
    "o AS (SELECT name, ordinal, length + CASE WHEN ordinal % 17 = 0 THEN 1 ELSE 0 END AS length, CASE WHEN ordinal % 23 = 0 THEN NULL WHEN ordinal % 19 = 0 THEN md5(name) ELSE md5 END AS md5 FROM e WHERE ordinal % 13 <> 0 "
    "UNION ALL SELECT 'extra' || ordinal, ordinal, length, md5 FROM e WHERE ordinal % 29 = 0) "
)


def _dictionaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _table(spark, sf_dir, "part")
    e = p.select(F.concat(F.lit("part"), "p_partkey").alias("name"), F.col("p_partkey").alias("ordinal"), F.col("p_size").cast("long").alias("length"), F.md5(F.col("p_name").cast("binary")).alias("md5"))
    k = F.col("ordinal")
    o = e.where(k % 13 != 0).select(
        "name", "ordinal", (F.col("length") + F.when(k % 17 == 0, 1).otherwise(0)).alias("length"), F.when(k % 23 == 0, None).when(k % 19 == 0, F.md5(F.col("name").cast("binary"))).otherwise(F.col("md5")).alias("md5")
    )
    return e, o.unionByName(e.where(k % 29 == 0).withColumn("name", F.concat(F.lit("extra"), "ordinal")))


@query(
    _DICTS + "SELECT 'record_count' AS kind, NULL::VARCHAR AS name, (SELECT count(*) FROM e)::VARCHAR AS expected, (SELECT count(*) FROM o)::VARCHAR AS observed WHERE (SELECT count(*) FROM e) <> (SELECT count(*) FROM o) "
    "UNION ALL SELECT 'missing_sequence', name, name, NULL FROM e WHERE name NOT IN (SELECT name FROM o) UNION ALL SELECT 'extra_sequence', name, NULL, name FROM o WHERE name NOT IN (SELECT name FROM e) "
    "UNION ALL SELECT 'length', name, e.length::VARCHAR, o.length::VARCHAR FROM e JOIN o USING (name) WHERE e.length <> o.length UNION ALL SELECT 'm5_conflict', name, e.md5, o.md5 FROM e JOIN o USING (name) WHERE e.md5 <> o.md5"
)
def dictionary_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.dictionary_differences(*_dictionaries(spark, sf_dir))


@query(_DICTS + "SELECT name FROM o JOIN e USING (name) WHERE o.md5 IS NULL")
def dictionary_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.dictionary_gaps(*_dictionaries(spark, sf_dir))


_INDEXES = (
    "WITH e AS (SELECT 'o' || o_orderkey AS name, o_orderkey AS ordinal, floor(o_totalprice)::BIGINT AS length, (o_orderkey * 10)::BIGINT AS offset_, 60::BIGINT AS line_bases, 61::BIGINT AS line_bytes FROM orders), "
    "o AS (SELECT name, ordinal + CASE WHEN ordinal % 50 = 7 THEN 1 WHEN ordinal % 50 = 8 THEN -1 ELSE 0 END AS ordinal, length + CASE WHEN ordinal % 11 = 0 THEN 1 ELSE 0 END AS length, "
    "offset_ + CASE WHEN ordinal % 13 = 0 THEN 2 ELSE 0 END AS offset_, line_bases, line_bytes + CASE WHEN ordinal % 17 = 0 THEN 1 ELSE 0 END AS line_bytes FROM e) "
)


@query(
    _INDEXES + "SELECT 'length' AS kind, name, e.length::VARCHAR AS expected, o.length::VARCHAR AS observed FROM e JOIN o USING (name) WHERE e.length <> o.length "
    "UNION ALL SELECT 'offset', name, e.offset_::VARCHAR, o.offset_::VARCHAR FROM e JOIN o USING (name) WHERE e.offset_ <> o.offset_ UNION ALL SELECT 'line_bytes', name, e.line_bytes::VARCHAR, o.line_bytes::VARCHAR FROM e JOIN o USING (name) WHERE e.line_bytes <> o.line_bytes "
    "UNION ALL SELECT 'order', name, e.ordinal::VARCHAR, o.ordinal::VARCHAR FROM e JOIN o USING (name) WHERE e.ordinal <> o.ordinal"
)
def index_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("ordinal")
    e = _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("name"), F.col("o_orderkey").alias("ordinal"), F.floor("o_totalprice").cast("long").alias("length"), (F.col("o_orderkey") * 10).alias("offset"), F.lit(60).cast("long").alias("line_bases"), F.lit(61).cast("long").alias("line_bytes")
    )
    o = e.select(
        "name", (k + F.when(k % 50 == 7, 1).when(k % 50 == 8, -1).otherwise(0)).alias("ordinal"), (F.col("length") + F.when(k % 11 == 0, 1).otherwise(0)).alias("length"), (F.col("offset") + F.when(k % 13 == 0, 2).otherwise(0)).alias("offset"),
        "line_bases", (F.col("line_bytes") + F.when(k % 17 == 0, 1).otherwise(0)).alias("line_bytes"),
    )
    return collections.index_differences(e, o)


# Variant records.
_RECORDS = (
    f"WITH {_ANCHOR}, r AS (SELECT l_orderkey, l_linenumber, 'doc' || (l_partkey * 3 // 5) AS sequence_name, (l_linenumber * 10 + l_quantity::BIGINT)::BIGINT AS position, l_returnflag FROM lineitem), "
    "j AS (SELECT r.*, a.name AS anchor_name, a.length AS anchor_length, substring(a.sequence, position, 2) AS slice FROM r LEFT JOIN anchor a ON a.name = r.sequence_name), "
    "v AS (SELECT *, CASE WHEN l_returnflag = 'R' OR NOT regexp_matches(coalesce(slice, ''), '^[ACGTNacgtn]{2}$') THEN 'NA' ELSE upper(slice) END AS ref FROM j), "
    "c AS (SELECT *, CASE WHEN anchor_name IS NULL THEN 'unresolved_sequence' WHEN position < 1 OR position + 1 > anchor_length THEN 'out_of_bounds' WHEN translate(upper(slice), 'BDHKMRSVWY', 'CAAGAACAAC') = ref THEN 'match' ELSE 'mismatch' END AS state FROM v) "
)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bases at a place; the anchor's own where it has plain bases there, unless the line was returned."""
    rows = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("doc"), F.expr("l_partkey * 3 div 5")).alias("sequence_name"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")).cast("long").alias("position"), "l_returnflag"
    )
    own = _anchor(spark, sf_dir, False).select(F.col("name").alias("_n"), F.col("sequence").alias("_s"))
    slice_ = F.substring(F.col("_s"), F.col("position").cast("int"), F.lit(2))
    ref = F.when((F.col("l_returnflag") == "R") | ~F.coalesce(slice_, F.lit("")).rlike("^[ACGTNacgtn]{2}$"), "NA").otherwise(F.upper(slice_))
    return rows.join(own, F.col("sequence_name") == F.col("_n"), "left").select("l_orderkey", "l_linenumber", "sequence_name", "position", ref.alias("ref"))


@query(_RECORDS + "SELECT l_orderkey, l_linenumber, sequence_name, position, state FROM c")
def refbase_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refbases.check(_records(spark, sf_dir), _anchor(spark, sf_dir, False)).select("l_orderkey", "l_linenumber", "sequence_name", "position", "state")


@query(_RECORDS + "SELECT l_orderkey, l_linenumber, sequence_name, position, state FROM c")
def refbase_check_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refbases.check_chunked(_records(spark, sf_dir), refbases.chunked(_anchor(spark, sf_dir, False))).select("l_orderkey", "l_linenumber", "sequence_name", "position", "state")


@query(_RECORDS + "SELECT sequence_name, position, ref, state, 2 * count(*)::BIGINT AS n FROM c GROUP BY sequence_name, position, ref, state")
def refbase_check_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record twice and without a key of its own, against short chunks, of which many records cover two."""
    records = _records(spark, sf_dir).select("sequence_name", "position", "ref")
    checked = refbases.check_chunked(records.unionByName(records), refbases.chunked(_anchor(spark, sf_dir, False), 64), 64)
    return checked.groupBy("sequence_name", "position", "ref", "state").agg(F.count(F.lit(1)).alias("n"))


_COUNTS = ", ".join(f"count(*) FILTER (state = '{s}')::BIGINT AS {s}" for s in refbases.STATES).replace("FILTER (", "FILTER (WHERE ")


@query(_RECORDS + f"SELECT sequence_name, {_COUNTS} FROM c GROUP BY sequence_name")
def refbase_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refbases.outcomes(refbases.check(_records(spark, sf_dir), _anchor(spark, sf_dir, False)))


@query(_RECORDS + "SELECT l_orderkey, l_linenumber, sequence_name, position, ref, state, CASE WHEN state = 'mismatch' THEN translate(slice, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS found FROM c WHERE state <> 'match'")
def refbase_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refbases.problems(refbases.check(_records(spark, sf_dir), _anchor(spark, sf_dir, False))).select("l_orderkey", "l_linenumber", "sequence_name", "position", "ref", "state", "found")


_PATTERN = (
    f", s AS (SELECT sequence_name, {_COUNTS} FROM c GROUP BY sequence_name), t AS (SELECT sum(match)::BIGINT AS n_match, sum(mismatch)::BIGINT AS n_mismatch, sum(out_of_bounds + unresolved_sequence)::BIGINT AS n_unresolved, "
    "count(*) FILTER (WHERE match + mismatch > 0)::BIGINT AS n_compared_sequences, count(*) FILTER (WHERE mismatch > 0)::BIGINT AS n_affected_sequences FROM s) "
    "SELECT *, CASE WHEN n_unresolved > 0 THEN 'unclassified' WHEN n_mismatch = 0 THEN 'none' WHEN n_mismatch = 1 THEN 'isolated' WHEN n_affected_sequences = n_compared_sequences AND n_compared_sequences >= 2 "
    "THEN CASE WHEN n_match = 0 THEN 'systematic' ELSE 'distributed' END ELSE 'localized' END AS pattern FROM t"
)


@query(_RECORDS + _PATTERN)
def conflict_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = refbases.check(_records(spark, sf_dir), _anchor(spark, sf_dir, False))
    return refbases.conflict_pattern(refbases.outcomes(checked))


# Intervals and annotation features.
_INTERVALS = (
    "WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS ordinal, 'doc' || (l_partkey * 3 // 5) AS sequence_name, (l_suppkey * 7 + l_linenumber * 100)::BIGINT AS start_, (l_suppkey * 7 + l_linenumber * 100 + l_quantity::BIGINT)::BIGINT AS end_ FROM lineitem), "
    "c AS (SELECT i.*, n_chars AS anchor_length, CASE WHEN d.doc_id IS NULL THEN 'unresolved_sequence' WHEN start_ >= 0 AND start_ <= end_ AND end_ <= n_chars THEN 'representable' ELSE 'out_of_bounds' END AS state "
    "FROM i LEFT JOIN documents d ON 'doc' || d.doc_id = i.sequence_name) "
)


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_suppkey") * 7 + F.col("l_linenumber") * 100
    return _table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.concat(F.lit("doc"), F.expr("l_partkey * 3 div 5")).alias("sequence_name"), start.cast("long").alias("start"), (start + F.col("l_quantity").cast("long")).cast("long").alias("end")
    )


@query(_INTERVALS + 'SELECT ordinal, sequence_name, start_ AS start, end_ AS "end", state FROM c')
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.check_intervals(_intervals(spark, sf_dir), _lengths(spark, sf_dir)).select("ordinal", "sequence_name", "start", "end", "state")


_ICOUNTS = ", ".join(f"count(*) FILTER (WHERE state = '{s}')::BIGINT AS {s}" for s in bounds.INTERVAL_STATES)


@query(_INTERVALS + f"SELECT sequence_name, {_ICOUNTS} FROM c GROUP BY sequence_name")
def bounds_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.outcomes(bounds.check_intervals(_intervals(spark, sf_dir), _lengths(spark, sf_dir)), bounds.INTERVAL_STATES)


@query(_INTERVALS + "SELECT count(*)::BIGINT AS checked, count(*) FILTER (WHERE state = 'out_of_bounds')::BIGINT AS conflict, count(*) FILTER (WHERE state = 'unresolved_sequence')::BIGINT AS unresolved FROM c")
def bounds_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.capability(bounds.check_intervals(_intervals(spark, sf_dir), _lengths(spark, sf_dir)))


@query(_INTERVALS + 'SELECT sequence_name, state, min(ordinal)::BIGINT AS ordinal, arg_min(start_, ordinal)::BIGINT AS start, arg_min(end_, ordinal)::BIGINT AS "end" FROM c WHERE state <> \'representable\' GROUP BY sequence_name, state')
def problem_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = bounds.check_intervals(_intervals(spark, sf_dir), _lengths(spark, sf_dir)).select("ordinal", "sequence_name", "start", "end", "state")
    return bounds.representatives(checked)


@query(
    _INTERVALS + "SELECT sequence_name, count(*)::BIGINT AS n_records, min(start_)::BIGINT AS min_start, max(end_)::BIGINT AS max_end, min(ordinal)::BIGINT AS first_ordinal, arg_min(start_, ordinal)::BIGINT AS first_line, "
    "count(*) FILTER (WHERE start_ = end_)::BIGINT AS n_empty FROM c GROUP BY sequence_name"
)
def interval_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.interval_usage(_intervals(spark, sf_dir).withColumn("line_number", F.col("start")))


@query("SELECT event_type AS sequence_name, count(*)::BIGINT AS n_records, min(event_id)::BIGINT AS first_ordinal FROM events GROUP BY event_type")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounds.usage(_table(spark, sf_dir, "events"), "event_type", "event_id")


# Features of circular sequences: customers are sequences, orders features; landmarks of some.
_FEATURES = (
    "WITH a AS (SELECT 'c' || c_custkey AS name, (100 + c_custkey % 50)::BIGINT AS length FROM customer WHERE c_custkey % 10 <> 9), "
    "f AS (SELECT o_orderkey AS ordinal, 'c' || o_custkey AS sequence_name, (1 + o_orderkey % 140)::BIGINT AS start_, (1 + o_orderkey % 140 + o_orderkey % 60)::BIGINT AS end_ FROM orders), "
    "m AS (SELECT 'c' || c_custkey AS sequence_name, CASE WHEN c_custkey % 6 = 2 THEN NULL ELSE 100 + c_custkey % 50 + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END END::BIGINT AS landmark_length FROM customer WHERE c_custkey % 2 = 0), "
    "j AS (SELECT f.*, a.length AS n, m.sequence_name IS NOT NULL AS has_landmark, landmark_length AS l, coalesce(landmark_length = a.length, false) AS established FROM f LEFT JOIN a ON a.name = f.sequence_name LEFT JOIN m USING (sequence_name)), "
    "w AS (SELECT *, CASE WHEN l IS NULL OR end_ <= l THEN 'none' WHEN start_ > l OR end_ - l > l OR end_ - l >= start_ THEN 'invalid' WHEN established THEN 'representable' ELSE 'unresolved' END AS wrap FROM j), "
    "c AS (SELECT *, CASE WHEN n IS NULL THEN 'unresolved_sequence' WHEN wrap = 'representable' THEN 'circular_representable' WHEN wrap IN ('unresolved', 'invalid') THEN 'circular_bounds_unresolved' WHEN end_ <= n THEN 'representable' "
    "WHEN has_landmark AND l IS NULL THEN 'circular_bounds_unresolved' ELSE 'out_of_bounds' END AS state FROM w) "
)


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    k = F.col("c_custkey")
    name = F.concat(F.lit("c"), k)
    anchor = c.where(k % 10 != 9).select(name.alias("name"), (100 + k % 50).cast("long").alias("length"))
    start = 1 + F.col("o_orderkey") % 140
    features = o.select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("line_number"), F.concat(F.lit("c"), "o_custkey").alias("sequence_name"), F.lit("gene").alias("feature_type"), start.cast("long").alias("start"), (start + F.col("o_orderkey") % 60).cast("long").alias("end"), F.lit(False).alias("is_circular"))
    # Landmarks: one region from 1, or one that starts at 2 and so gives no length.
    end = 100 + k % 50 + F.when(k % 4 == 0, 1).otherwise(0)
    marks = c.where(k % 2 == 0).select((-k).alias("ordinal"), (-k).alias("line_number"), name.alias("sequence_name"), F.lit("region").alias("feature_type"), F.when(k % 6 == 2, 2).otherwise(1).cast("long").alias("start"), end.cast("long").alias("end"), F.lit(True).alias("is_circular"))
    return features, marks, anchor


@query(_FEATURES + 'SELECT ordinal, sequence_name, start_ AS start, end_ AS "end", wrap, state FROM c')
def circular_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, marks, anchor = _features(spark, sf_dir)
    return bounds.check_features(features, anchor, marks=bounds.landmarks(marks, anchor)).select("ordinal", "sequence_name", "start", "end", "wrap", "state")


@query(_FEATURES + "SELECT sequence_name, " + ", ".join(f"count(*) FILTER (WHERE state = '{s}')::BIGINT AS {s}" for s in bounds.FEATURE_STATES) + " FROM c GROUP BY sequence_name")
def features_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, marks, anchor = _features(spark, sf_dir)
    return bounds.outcomes(bounds.check_features(features, anchor, marks=bounds.landmarks(marks, anchor)))


@query(
    _FEATURES + ", r AS (SELECT 'c' || c_custkey AS sequence_name, 1 AS from_, 120 AS to_ FROM customer WHERE c_custkey % 3 = 0) "
    "SELECT ordinal, ordinal AS line_number, CASE WHEN wrap = 'invalid' THEN 'circular feature wraps more than once' ELSE 'feature lies outside its declared sequence-region' END AS error FROM c LEFT JOIN r USING (sequence_name) "
    "WHERE wrap = 'invalid' OR (wrap = 'none' AND (start_ < from_ OR end_ > to_))"
)
def feature_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, marks, anchor = _features(spark, sf_dir)
    regions = _table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("sequence_name"), F.lit(1).cast("long").alias("start"), F.lit(120).cast("long").alias("end"))
    return bounds.feature_errors(bounds.check_features(features, anchor, marks=bounds.landmarks(marks, anchor)), regions)


@query(
    "WITH b AS (SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY l_linenumber, l_quantity) AS sizes, list((CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber * 40 - 40 END)::BIGINT ORDER BY l_linenumber, l_quantity) AS starts, count(*) AS n FROM lineitem GROUP BY l_orderkey), "
    "s AS (SELECT l_orderkey, sizes, starts, n + CASE WHEN l_orderkey % 23 = 0 THEN 1 ELSE 0 END AS n, starts[len(starts)] + sizes[len(sizes)] + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS span FROM b) "
    "SELECT l_orderkey, CASE WHEN n < 1 THEN 'block count must be positive' WHEN n > span THEN 'more blocks than bases' WHEN len(sizes) <> n THEN 'block lists and block count differ in length' WHEN len(list_filter(sizes, lambda z: z < 1)) > 0 THEN 'a block is empty' "
    "WHEN starts[1] <> 0 THEN 'the first block must start at 0' WHEN list_max(list_transform(range(1, len(sizes) + 1), lambda i: starts[i] + sizes[i])) > span THEN 'a block reaches beyond the interval' "
    "WHEN len(list_filter(range(2, len(sizes) + 1), lambda i: starts[i] < starts[i - 1] + sizes[i - 1])) > 0 THEN 'blocks overlap or are out of order' WHEN starts[len(starts)] + sizes[len(sizes)] <> span THEN 'the last block must end with the interval' END AS error FROM s"
)
def block_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(n, F.col("l_quantity").cast("long").alias("z"), F.when(n == 1, 0).otherwise(n * 40 - 40).cast("long").alias("s")).alias("b"))
    lists = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("b")).alias("b"))  # an order has a handful of lines
    sizes, starts = F.transform("b", lambda x: x["z"]), F.transform("b", lambda x: x["s"])
    count = F.size("b") + F.when(F.col("l_orderkey") % 23 == 0, 1).otherwise(0)
    span = F.get(starts, F.size("b") - 1) + F.get(sizes, F.size("b") - 1) + F.when(F.col("l_orderkey") % 5 == 0, 1).otherwise(0)
    made = lists.select("l_orderkey", sizes.alias("sizes"), starts.alias("starts"), count.alias("n"), span.alias("span"))
    return made.select("l_orderkey", bounds.block_error(F.col("span"), F.col("n"), F.col("sizes"), F.col("starts")).alias("error"))


# Aliases, relations, order.
_ALIASES = "aliases AS (SELECT 'alias' || (s_suppkey % 300) AS alias, n_name AS canonical_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), names AS (SELECT 'alias' || c_custkey AS local_name FROM customer UNION SELECT n_name FROM nation)"


@query(
    f"WITH {_ALIASES}, t AS (SELECT alias, count(DISTINCT canonical_name) AS n, min(canonical_name) AS target FROM aliases GROUP BY alias), "
    "r AS (SELECT local_name, n_name, n, target, CASE WHEN n_name IS NOT NULL THEN 'canonical_name' WHEN n > 1 THEN 'ambiguous_alias' WHEN n = 1 THEN 'authoritative_alias' ELSE 'undeclared_name' END AS reason "
    "FROM names LEFT JOIN nation ON n_name = local_name LEFT JOIN t ON alias = local_name) SELECT local_name, CASE WHEN reason IN ('canonical_name', 'authoritative_alias') THEN 'resolved' ELSE 'unresolved' END AS state, "
    "CASE WHEN reason IN ('canonical_name', 'authoritative_alias') THEN reason END AS method, reason, CASE reason WHEN 'canonical_name' THEN n_name WHEN 'authoritative_alias' THEN target END AS canonical_name FROM r"
)
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, c = (_table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    aliases = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("alias"), F.col("s_suppkey") % 300).alias("alias"), F.col("n_name").alias("canonical_name"))
    names = c.select(F.concat(F.lit("alias"), "c_custkey").alias("local_name")).unionByName(n.select(F.col("n_name").alias("local_name")))
    return resolve.resolve_aliases(names, n.select(F.col("n_name").alias("canonical_name")), aliases)


@query(
    "WITH x AS (SELECT 'a' || s_nationkey AS anchor_name, count(DISTINCT s_suppkey)::BIGINT AS n_targets, count(DISTINCT CASE WHEN s_suppkey % 20 = 0 THEN s_suppkey END) AS n_mandatory, min(CASE WHEN s_suppkey % 20 = 0 THEN 's' || s_suppkey END) AS sole FROM supplier GROUP BY 1) "
    "SELECT anchor_name, n_targets, CASE WHEN n_mandatory = 1 THEN sole END AS survivor FROM x WHERE n_targets >= 2"
)
def axis_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    rows = s.select(F.concat(F.lit("a"), "s_nationkey").alias("anchor_name"), F.concat(F.lit("s"), "s_suppkey").alias("canonical_name"), (F.col("s_suppkey") % 20 == 0).alias("mandatory"))
    return resolve.axis_collisions(rows)


@query(
    "WITH a AS (SELECT DISTINCT doc_id AS k FROM documents), o AS (SELECT DISTINCT conv_id AS k FROM conversations), n AS (SELECT (SELECT count(*) FROM a JOIN o USING (k))::BIGINT AS n_both, (SELECT count(*) FROM a WHERE k NOT IN (SELECT k FROM o))::BIGINT AS n_anchor_only, "
    "(SELECT count(*) FROM o WHERE k NOT IN (SELECT k FROM a))::BIGINT AS n_other_only) SELECT *, CASE WHEN n_both = 0 THEN 'disjoint' WHEN n_anchor_only = 0 AND n_other_only = 0 THEN 'exact' WHEN n_other_only = 0 THEN 'alignment_subset' WHEN n_anchor_only = 0 THEN 'alignment_superset' ELSE 'overlap' END AS relation FROM n"
)
def membership_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.membership(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name")), _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("name")))


@query(
    "WITH t AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN -turn ELSE turn END AS o FROM conversations), l AS (SELECT conv_id, turn, o, lag(o) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM t) "
    "SELECT conv_id, count(*)::BIGINT AS n_shared, CASE WHEN coalesce(bool_or(o < before), false) THEN 'different' ELSE 'consistent' END AS relation FROM l GROUP BY conv_id"
)
def order_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("string").alias("name"), F.col("turn").alias("ordinal"))
    other = t.withColumn("ordinal", F.when(F.col("conv_id") % 3 == 0, -F.col("ordinal")).otherwise(F.col("ordinal")))
    return collections.same_order(t, other, ["conv_id"])


def _alignment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    anchor, peer = _anchor(spark, sf_dir), _peer(spark, sf_dir)
    rows = peer.withColumn("ordinal", F.substring("name", 5, 20).cast("long"))
    rows = rows.withColumn("name", F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("doc"), "ordinal")).otherwise(F.col("name")))
    rows = rows.unionByName(rows.where("ordinal % 50 = 1").withColumn("name", F.concat(F.lit("copy"), "ordinal")))
    return rows, anchor, resolve.declared_bindings(rows, anchor, need_length=True)


_ALIGNMENT = (
    f"WITH {_ANCHOR}, {_PEER}, d AS (SELECT CASE WHEN substring(name, 5)::BIGINT % 2 = 0 THEN 'doc' || substring(name, 5) ELSE name END AS name, length, md5 FROM peer UNION ALL SELECT 'copy' || substring(name, 5), length, md5 FROM peer WHERE substring(name, 5)::BIGINT % 50 = 1), "
    "u AS (SELECT md5, min(name) AS name, min(length) AS length FROM anchor GROUP BY md5 HAVING count(*) = 1), b AS (SELECT d.name, u.name AS bound FROM d JOIN u USING (md5) WHERE d.length = u.length AND d.name <> u.name), "
    "r AS (SELECT d.name, coalesce(bound, a.name) AS anchor_name, CASE WHEN bound IS NOT NULL THEN 'verified_m5_binding' WHEN a.name IS NOT NULL THEN 'exact_name' WHEN d.md5 IS NOT NULL AND d.md5 NOT IN (SELECT md5 FROM anchor) THEN 'distinct_extra' ELSE 'unresolved' END AS method "
    "FROM d LEFT JOIN b ON b.name = d.name LEFT JOIN anchor a ON a.name = d.name) "
)


@query(_ALIGNMENT + "SELECT name, method, anchor_name FROM r")
def alignment_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, anchor, bindings = _alignment(spark, sf_dir)
    return alignment.resolve_dictionary(rows, anchor, bindings).select("name", "method", "anchor_name")


@query(_ALIGNMENT + "SELECT anchor_name, count(*)::BIGINT AS n FROM r WHERE anchor_name IS NOT NULL GROUP BY anchor_name HAVING count(*) > 1")
def alignment_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, anchor, bindings = _alignment(spark, sf_dir)
    return alignment.duplicate_targets(alignment.resolve_dictionary(rows, anchor, bindings))


# A whole bundle: a variant file whose contigs are the documents' names.
_BUNDLE = (
    _RECORDS + ", used AS (SELECT DISTINCT sequence_name AS name FROM c), contigs AS (SELECT 'doc' || doc_id AS name, CASE WHEN doc_id % 5 <> 0 THEN n_chars + CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END END AS length, "
    "CASE WHEN doc_id % 5 = 0 OR doc_id % 41 = 0 THEN 'none' WHEN doc_id % 37 = 0 THEN md5(text) ELSE " + _MD5.format("text") + " END AS md5 FROM documents), "
    "k AS (SELECT contigs.* FROM contigs WHERE name IN (SELECT name FROM used)), t AS (SELECT count(*) AS checked, count(*) FILTER (WHERE state = 'mismatch') AS conflict, count(*) FILTER (WHERE state IN ('out_of_bounds', 'unresolved_sequence')) AS unresolved FROM c), "
    "q AS (SELECT 'presence' AS kind, name AS sequence_name, CASE WHEN name IN (SELECT name FROM anchor) THEN 'satisfied' ELSE 'unresolved' END AS state, '\"presence\",\"calls\",\"' || name || '\"' AS id FROM used "
    "UNION ALL SELECT 'length', k.name, CASE WHEN a.name IS NULL THEN 'unresolved' WHEN a.length = k.length THEN 'satisfied' ELSE 'unsatisfied' END, '\"length\",\"calls\",\"' || k.name || ':' || k.length || '\"' FROM k LEFT JOIN anchor a ON a.name = k.name WHERE k.length IS NOT NULL "
    "UNION ALL SELECT 'identity', k.name, CASE WHEN a.name IS NULL THEN 'unresolved' WHEN a.md5 = k.md5 THEN 'satisfied' ELSE 'unsatisfied' END, '\"identity\",\"calls\",\"' || k.name || ':' || k.md5 || '\"' FROM k LEFT JOIN anchor a ON a.name = k.name WHERE k.md5 <> 'none' "
    "UNION ALL SELECT 'bases', NULL, CASE WHEN checked = 0 THEN 'not_applicable' WHEN conflict > 0 THEN 'unsatisfied' WHEN unresolved > 0 THEN 'unresolved' ELSE 'satisfied' END, '\"reference-bases\",\"calls\",\"documents:' || checked || '\"' FROM t), "
    "z AS (SELECT 'vcf-requirement:' || sha256('[' || id || ']') AS requirement_id, kind, sequence_name, state FROM q) "
)


def _bundle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records are checked once; usage, count and capability come from the outcomes by sequence, digests from one pass over the texts."""
    k = F.col("ordinal")
    facts = written(_anchor(spark, sf_dir).withColumn("plain", F.md5(F.col("sequence").cast("binary"))).drop("sequence"), "anchor")
    by_sequence = written(refbases.outcomes(refbases.check(_records(spark, sf_dir), _anchor(spark, sf_dir, False))), "outcomes")
    usage = by_sequence.select("sequence_name")
    contigs = facts.select(
        "name", F.when(k % 5 != 0, F.col("length") + F.when(k % 31 == 0, 1).otherwise(0)).alias("length"), F.when((k % 5 == 0) | (k % 41 == 0), "none").when(k % 37 == 0, F.col("plain")).otherwise(F.col("md5")).alias("md5")
    )
    count = refbases.capability(by_sequence.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in refbases.STATES]))
    requirements = contracts.variant_contract("calls", "documents", usage, contigs, count)
    capabilities = contracts.anchor_capabilities("documents", facts, with_order=False).unionByName(contracts.check_capability("bases", "calls", "documents", count))
    return requirements, capabilities


@query(_BUNDLE + "SELECT requirement_id, kind, sequence_name, state FROM z")
def constraint_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.constraints("documents", *_bundle(spark, sf_dir)).select("requirement_id", "kind", "sequence_name", "state")


@query(
    _BUNDLE + "SELECT count(*) FILTER (WHERE state = 'satisfied')::BIGINT AS n_satisfied, count(*) FILTER (WHERE state = 'unsatisfied')::BIGINT AS n_unsatisfied, count(*) FILTER (WHERE state = 'unresolved')::BIGINT AS n_unresolved, count(*) FILTER (WHERE state = 'not_applicable')::BIGINT AS n_not_applicable, "
    "CASE WHEN bool_or(state = 'unsatisfied') THEN 'incompatible' WHEN bool_or(state = 'unresolved') OR NOT bool_or(state = 'satisfied') THEN 'indeterminate' ELSE 'compatible' END AS verdict FROM z"
)
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reason("documents", *_bundle(spark, sf_dir))["verdict"]


@query(
    _BUNDLE + "SELECT requirement_id, CASE kind WHEN 'presence' THEN 'sequence_presence' WHEN 'length' THEN 'sequence_length' WHEN 'identity' THEN 'sequence_identity' ELSE 'reference_bases' END AS evidence_kind, "
    "CASE WHEN kind = 'bases' THEN 'exhaustive_reference_base_validation' ELSE 'exact_typed_constraint' END AS method, CASE WHEN kind IN ('identity', 'bases') THEN 'tier_a_conclusive_content' ELSE 'tier_b_direct_structural' END AS strength, "
    "CASE WHEN state = 'satisfied' THEN 'supports' ELSE 'contradicts' END AS polarity FROM z WHERE state IN ('satisfied', 'unsatisfied')"
)
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reason("documents", *_bundle(spark, sf_dir))["evidence"].select("requirement_id", "evidence_kind", "method", "strength", "polarity")


@query(
    _BUNDLE + "SELECT requirement_id, state, CASE WHEN state = 'unresolved' THEN 'unresolved_requirement' WHEN kind = 'presence' THEN 'missing_required_sequence' WHEN kind = 'length' THEN 'sequence_length_conflict' WHEN kind = 'identity' THEN 'sequence_identity_conflict' ELSE 'reference_base_conflict' END AS finding_kind "
    "FROM z WHERE state IN ('unsatisfied', 'unresolved')"
)
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reason("documents", *_bundle(spark, sf_dir))["findings"].select("requirement_id", "state", "finding_kind")


@query(_BUNDLE + ", w AS (SELECT bool_or(state = 'unsatisfied') AS bad FROM z) SELECT requirement_id, CASE WHEN bad THEN 'contradiction' ELSE 'unresolved' END AS core_kind FROM z, w WHERE state = CASE WHEN bad THEN 'unsatisfied' ELSE 'unresolved' END")
def conflict_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.reason("documents", *_bundle(spark, sf_dir))["cores"].select("requirement_id", "core_kind")


# Orders: each conversation lists its turns, some backwards, some without the last, some by other names that bindings tell.
_ORDERS = (
    "WITH a AS (SELECT list('t' || turn ORDER BY turn) AS names FROM (SELECT DISTINCT turn FROM conversations WHERE turn < 4)), "
    "p AS (SELECT conv_id, 't' || turn AS name, CASE WHEN conv_id % 5 = 1 THEN -turn ELSE turn END AS place FROM conversations WHERE turn < 4 OR conv_id % 7 = 3), "
    "l AS (SELECT conv_id, list(name ORDER BY place) AS names FROM p GROUP BY conv_id) "
)


@query(
    _ORDERS + "SELECT 'order' || conv_id AS requirement_id, CASE WHEN NOT list_has_all(a.names, l.names) THEN 'unresolved' WHEN a.names = l.names THEN 'satisfied' ELSE 'unsatisfied' END AS state, "
    "CASE WHEN a.names = l.names THEN CASE WHEN conv_id % 3 = 0 THEN 'verified_alias' ELSE 'exact' END END AS mode FROM l, a"
)
def order_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"))
    anchor = t.where("turn < 4").select(F.concat(F.lit("t"), "turn").alias("name"), F.col("turn").alias("ordinal")).distinct().withColumn("length", F.lit(None).cast("long"))
    own = F.concat(F.when(F.col("conv_id") % 3 == 0, "alias").otherwise("t"), F.col("turn"))
    place = F.when(F.col("conv_id") % 5 == 1, -F.col("turn")).otherwise(F.col("turn"))
    rows = t.where("turn < 4 or conv_id % 7 = 3").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), own.alias("name")))), lambda x: x["name"]).alias("names"))
    resource = F.concat(F.lit("talk"), "conv_id")
    requirements = shaped(rows.select(F.concat(F.lit("order"), "conv_id").alias("requirement_id"), resource.alias("resource_id"), F.lit("order").alias("kind"), F.lit("mandatory").alias("level"), "names"), REQUIREMENT)
    bound = t.where("conv_id % 3 = 0").select(F.concat(F.lit("b"), "conv_id", F.lit("."), "turn").alias("binding_id"), resource.alias("resource_id"), F.concat(F.lit("alias"), "turn").alias("local_name"), F.concat(F.lit("t"), "turn").alias("anchor_name"))
    return evaluate.constraints("turns", requirements, contracts.anchor_capabilities("turns", anchor), bound).select("requirement_id", "state", "mode")


# Names through bindings, merged bindings, consistency of namings.
@query(
    "WITH n AS (SELECT 'c' || c_custkey AS name FROM customer), b AS (SELECT 'o' || o_orderkey AS local_name, 'c' || o_custkey AS anchor_name FROM orders WHERE o_orderkey % 3 = 0) "
    "SELECT 'o' || o_orderkey AS sequence_name, a.name AS anchor_name, coalesce(c.c_nationkey, -1)::BIGINT AS anchor_length FROM orders LEFT JOIN b ON b.local_name = 'o' || o_orderkey "
    "LEFT JOIN n a ON a.name = coalesce(b.anchor_name, 'o' || o_orderkey) LEFT JOIN customer c ON 'c' || c.c_custkey = a.name"
)
def name_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    anchor = c.select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_nationkey").cast("long").alias("length"))
    named = o.select(F.concat(F.lit("o"), "o_orderkey").alias("sequence_name"), "o_orderkey", "o_custkey")
    bindings = named.where("o_orderkey % 3 = 0").select(F.col("sequence_name").alias("local_name"), F.concat(F.lit("c"), "o_custkey").alias("anchor_name"))
    return resolve.resolve_names(named.select("sequence_name"), anchor, bindings).withColumn("anchor_length", F.coalesce("anchor_length", F.lit(-1)))


_MERGE = "WITH d AS (SELECT 'n' || s_suppkey AS local_name, 'a' || s_nationkey AS anchor_name FROM supplier WHERE s_suppkey % 2 = 0), x AS (SELECT 'n' || s_suppkey AS local_name, 'a' || (s_nationkey + CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END) AS anchor_name FROM supplier) "


def _bindings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = _table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("n"), "s_suppkey").alias("local_name")
    derived = s.where("s_suppkey % 2 = 0").select(name, F.concat(F.lit("a"), "s_nationkey").alias("anchor_name"))
    return derived, s.select(name, F.concat(F.lit("a"), F.col("s_nationkey") + F.when(F.col("s_suppkey") % 10 == 0, 1).otherwise(0)).alias("anchor_name"))


@query(_MERGE + "SELECT * FROM d UNION ALL SELECT * FROM x WHERE local_name NOT IN (SELECT local_name FROM d)")
def binding_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_bindings(*_bindings(spark, sf_dir))


@query(_MERGE + "SELECT local_name, x.anchor_name AS given, d.anchor_name FROM x JOIN d USING (local_name) WHERE x.anchor_name <> d.anchor_name")
def binding_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.binding_conflicts(*_bindings(spark, sf_dir))


@query(
    f"WITH {_ANCHOR}, t AS (SELECT 'doc' || doc_id AS local_name, 'doc' || (CASE WHEN doc_id % 9 = 4 THEN doc_id - 1 ELSE doc_id END) AS anchor_name, {_MD5.format('text')} AS value FROM documents), "
    "e AS (SELECT md5 AS value, count(*) AS n FROM anchor GROUP BY md5) SELECT local_name, t.anchor_name, (a.md5 = t.value AND coalesce(e.n, 0) = 1) AS consistent FROM t JOIN anchor a ON a.name = t.anchor_name JOIN e ON e.value = t.value"
)
def naming_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = _anchor(spark, sf_dir)
    local = anchor.select(F.col("name").alias("local_name"), F.lit("md5").alias("scheme"), F.col("md5").alias("value"))
    targets = anchor.select(F.col("name").alias("local_name"), F.concat(F.lit("doc"), F.when(F.col("ordinal") % 9 == 4, F.col("ordinal") - 1).otherwise(F.col("ordinal"))).alias("anchor_name"))
    return resolve.identity_consistency(local, anchor, targets)


@query(
    "WITH r AS (SELECT 'doc' || (c_custkey % 1500) AS sequence_name, 1 AS start_, (500 + c_custkey * 3 % 4000)::BIGINT AS end_ FROM customer) SELECT sequence_name, end_ AS \"end\", "
    "CASE WHEN doc_id IS NULL THEN 'unresolved_sequence' WHEN end_ <= n_chars THEN 'representable' ELSE 'out_of_bounds' END AS state FROM r LEFT JOIN documents ON 'doc' || doc_id = sequence_name"
)
def region_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    regions = _table(spark, sf_dir, "customer").select(F.concat(F.lit("doc"), k % 1500).alias("sequence_name"), F.lit(1).cast("long").alias("start"), (500 + k * 3 % 4000).cast("long").alias("end"))
    return bounds.check_regions(regions, _lengths(spark, sf_dir)).select("sequence_name", "end", "state")


@query("SELECT sequence_name, n_records, min_start, max_end, first_ordinal, n_circular, n_landmarks FROM (SELECT event_type AS sequence_name, count(*)::BIGINT AS n_records, min(event_id % 97)::BIGINT AS min_start, max(event_id % 97 + 5)::BIGINT AS max_end, min(event_id)::BIGINT AS first_ordinal, "
    "count(*) FILTER (WHERE event_id % 7 = 0)::BIGINT AS n_circular, count(*) FILTER (WHERE event_id % 7 = 0 AND user_id % 2 = 0)::BIGINT AS n_landmarks FROM events GROUP BY event_type)")
def feature_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    start = F.col("event_id") % 97
    rows = e.select(
        F.col("event_type").alias("sequence_name"), F.col("event_type").alias("raw_sequence_name"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("line_number"), start.alias("start"), (start + 5).alias("end"),
        (F.col("event_id") % 7 == 0).alias("is_circular"), F.when(F.col("user_id") % 2 == 0, "region").otherwise("gene").alias("feature_type"),
    )
    return bounds.feature_usage(rows).select("sequence_name", "n_records", "min_start", "max_end", "first_ordinal", "n_circular", "n_landmarks")


# Parsers on lines made of line items.
@query(
    "WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS line_number, l_partkey % 40 AS p, l_suppkey AS s, l_quantity::BIGINT AS q FROM lineitem) SELECT line_number, CASE WHEN p = 1 THEN 'chrom must be 1 to 255 ASCII letters, digits or underscores' WHEN p = 2 THEN 'chromStart is not an unsigned 64-bit integer' "
    "WHEN p = 3 THEN 'expected 3 fields' WHEN p = 4 AND q > 0 THEN 'chromStart exceeds chromEnd' WHEN p = 5 THEN 'track and browser lines are not allowed' END AS error, CASE WHEN p NOT IN (1, 2, 3, 5) THEN (s + CASE WHEN p = 4 THEN q ELSE 0 END)::BIGINT ELSE -1 END AS start FROM l WHERE p <> 6"
)
def interval_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import bed

    p, s, q = F.col("l_partkey") % 40, F.col("l_suppkey"), F.col("l_quantity").cast("long")
    plain = F.concat_ws("\t", F.lit("chr1"), (s + F.when(p == 4, q).otherwise(0)).cast("string"), (s + F.when(p == 4, 0).otherwise(q)).cast("string"))
    value = (
        F.when(p == 1, F.concat(F.lit("chr.1\t"), s, F.lit("\t"), s)).when(p == 2, F.concat(F.lit("chr1\t-"), s, F.lit("\t"), s)).when(p == 3, F.lit("chr1\t5")).when(p == 5, F.lit("track name=x")).when(p == 6, F.lit("# remark")).otherwise(plain)
    )
    lines = _table(spark, sf_dir, "lineitem").select(F.lit("lines").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_number"), value.alias("value"))
    parsed = bed.parse(lines, "bed3")
    broken = F.coalesce(~F.col("error").startswith("chromStart exceeds"), F.lit(False))
    return parsed.select("line_number", "error", F.coalesce(F.when(~broken, F.col("start").cast("long")), F.lit(-1)).alias("start"))


@query(
    "SELECT o_orderkey AS line_number, CASE o_orderkey % 14 WHEN 1 THEN 'name must have 1 to 255 characters' WHEN 2 THEN 'score exceeds 1000' WHEN 3 THEN 'score is not an unsigned integer' WHEN 4 THEN 'strand must be +, - or .' "
    "WHEN 5 THEN 'thickStart lies outside the feature' WHEN 6 THEN 'thickEnd lies before thickStart or outside the feature' WHEN 7 THEN 'itemRgb must be 0 or three integers up to 255' WHEN 8 THEN 'blockCount is not an unsigned integer' "
    "WHEN 9 THEN 'blockSizes is not a list of integers' WHEN 10 THEN 'blockStarts is not a list of integers' WHEN 11 THEN 'block lists and block count differ in length' WHEN 12 THEN 'the first block must start at 0' "
    "WHEN 13 THEN 'a block reaches beyond the interval' END AS error, o_custkey + 1 AS start FROM orders"
)
def interval_parse_twelve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import bed

    p, c = F.col("o_orderkey") % 14, F.col("o_custkey") + 1

    def field(usual: str, *odd: tuple[int, str]) -> Column:
        value = F.lit(usual)
        for k, text in odd:
            value = F.when(p == k, text).otherwise(value)
        return value

    line = F.concat_ws(
        "\t", F.lit("chr1"), c.cast("string"), (c + 100).cast("string"), field("n", (1, "")), field("0", (2, "1001"), (3, "x")), field("+", (4, "x")), (c - F.when(p == 5, 1).otherwise(0)).cast("string"), (c + 100 + F.when(p == 6, 1).otherwise(0)).cast("string"),
        field("255,0,9", (7, "1,2")), field("2", (8, "x"), (11, "3")), field("10,20", (9, "a"), (13, "10,30")), field("0,80,", (10, "0,x"), (12, "1,80")),
    )
    lines = _table(spark, sf_dir, "orders").select(F.lit("lines").alias("path"), F.col("o_orderkey").alias("line_number"), line.alias("value"))
    return bed.parse(lines, "bed12").select("line_number", "error", F.col("start").cast("long").alias("start"))


@query(
    "WITH l AS (SELECT o_orderkey AS line_number, o_orderkey % 12 AS p, o_custkey AS c FROM orders) SELECT line_number, CASE p WHEN 1 THEN 'a record has at least five tab-separated fields' WHEN 2 THEN 'POS is not a non-negative integer' WHEN 3 THEN 'REF must be bases' END AS error, "
    "CASE WHEN p NOT IN (1, 2) THEN c ELSE -1 END AS position FROM l WHERE p <> 0"
)
def variant_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import variants

    p, c = F.col("o_orderkey") % 12, F.col("o_custkey").cast("string")
    value = F.when(p == 0, "#CHROM").when(p == 1, "chr1\t5").otherwise(F.concat_ws("\t", F.lit("chr1"), F.when(p == 2, F.concat(F.lit("x"), c)).otherwise(c), F.lit("."), F.when(p == 3, "A<X>").otherwise("acgtN"), F.lit("T"), F.lit("rest\tof\tline")))
    lines = _table(spark, sf_dir, "orders").select(F.lit("lines").alias("path"), F.col("o_orderkey").alias("line_number"), value.alias("value"))
    return variants.parse_records(lines).select("line_number", "error", F.coalesce(F.when(~F.coalesce(F.col("error").startswith("a record"), F.lit(False)), F.col("position")), F.lit(-1)).alias("position"))


@query(
    "WITH l AS (SELECT o_orderkey AS line_number, o_orderkey % 11 AS p, o_custkey AS c FROM orders) SELECT line_number, CASE p WHEN 1 THEN 'a feature has nine tab-separated fields' WHEN 2 THEN 'start is not a positive integer' WHEN 3 THEN CASE WHEN c = 0 THEN 'end is not a positive integer' ELSE 'start exceeds end' END WHEN 4 THEN 'invalid sequence id' WHEN 5 THEN 'Is_circular must be true' END AS error, "
    "CASE WHEN p = 6 THEN 'a b' WHEN p NOT IN (1, 4) THEN 'chr1' END AS sequence_name, p = 7 AS is_circular FROM l WHERE p <> 0"
)
def annotation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import annotation

    p, c = F.col("o_orderkey") % 11, F.col("o_custkey") + 1
    name = F.when(p == 4, "chr%41").when(p == 6, "a%20b").otherwise("chr1")
    extra = F.when(p == 5, "Is_circular=yes").when(p == 7, "ID=x;Is_circular=true").otherwise("ID=y")
    line = F.concat_ws("\t", name, F.lit("x"), F.lit("gene"), F.when(p == 2, "0").otherwise(c.cast("string")), (c - F.when(p == 3, 1).otherwise(0)).cast("string"), F.lit("."), F.lit("."), F.lit("."), extra)
    value = F.when(p == 0, "# remark").when(p == 1, "chr1\tx").otherwise(line)
    lines = _table(spark, sf_dir, "orders").select(F.lit("lines").alias("path"), F.col("o_orderkey").alias("line_number"), value.alias("value"))
    parsed = annotation.parse_features(lines, "gff3")
    return parsed.select("line_number", "error", F.when(~F.coalesce(F.col("error").startswith("a feature"), F.lit(False)), F.col("sequence_name")).alias("sequence_name"), "is_circular")


def _gff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer a region, a claim and a remark; behind them, as embedded sequences, the customers' bases."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("c"), k)
    end = (100 + k - F.when(k % 5 == 0, 200 + k).otherwise(0)).cast("string")
    above = [F.concat_ws(" ", F.lit("##sequence-region"), name, F.lit("1"), end), F.concat(F.lit("#!genome-build B"), k), F.concat(F.lit("##species  S"), k)]
    bases = F.repeat(F.lit("acGT-n"), (1 + k % 7).cast("int"))
    below = [F.concat(F.lit("> "), F.when(k % 9 == 0, "c9").otherwise(name)), bases, F.when(k % 11 == 0, F.lit(";x")).otherwise(F.lit("AC"))]
    lines = [F.struct((k * 4 + i).alias("line_number"), v.alias("value")) for i, v in enumerate(above)] + [F.struct((10**9 + 1 + k * 4 + i).alias("line_number"), v.alias("value")) for i, v in enumerate(below)]
    rows = _table(spark, sf_dir, "customer").select(F.explode(F.array(*lines)).alias("x")).select("x.*")
    mark = spark.createDataFrame([(10**9, "##FASTA")], "line_number long, value string")
    return rows.unionByName(mark).select(F.lit("lines").alias("path"), "line_number", "value")


@query(
    "SELECT c_custkey * 4 AS line_number, 'c' || c_custkey AS sequence_name, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE 100 + c_custkey END::BIGINT AS \"end\", CASE WHEN c_custkey % 5 = 0 THEN 'a sequence-region''s bounds are positive integers' END AS error FROM customer"
)
def annotation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import annotation

    return annotation.parse_regions(_gff_lines(spark, sf_dir)).select("line_number", "sequence_name", F.coalesce(F.col("end").cast("long"), F.lit(-1)).alias("end"), "error")


@query("SELECT c_custkey * 4 + 1 AS line_number, '#!genome-build' AS name, 'B' || c_custkey AS value FROM customer UNION ALL SELECT c_custkey * 4 + 2, '##species', 'S' || c_custkey FROM customer")
def annotation_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import annotation

    return annotation.claims(_gff_lines(spark, sf_dir), "gff3").select("line_number", "name", "value")


@query(
    "WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN 'c9' ELSE 'c' || c_custkey END AS name, repeat('ACGTN', (1 + c_custkey % 7)::INTEGER) || CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE 'AC' END AS bases FROM customer), "
    "f AS (SELECT name, min(k) AS first FROM s GROUP BY name) SELECT CASE WHEN k % 11 = 0 THEN 1000000003 + k * 4 ELSE 1000000001 + k * 4 END AS line_number, name AS sequence_name, length(bases)::BIGINT AS length, md5(bases) AS md5, "
    "CASE WHEN k % 11 = 0 THEN 'a comment in an embedded sequence' WHEN k > first THEN 'an embedded sequence appears twice' END AS error FROM s JOIN f USING (name)"
)
def annotation_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import annotation

    return annotation.embedded(_gff_lines(spark, sf_dir)).select("line_number", "sequence_name", "length", "md5", "error")


@query(
    "WITH l AS (SELECT c_custkey AS line_number, c_custkey % 10 AS p, c_custkey AS c FROM customer) SELECT line_number, CASE p WHEN 1 THEN 'an index line has five tab-separated fields' WHEN 2 THEN 'fields 2 to 5 are integers' WHEN 3 THEN 'more bases per line than bases' WHEN 4 THEN 'fewer bytes than bases per line' "
    "WHEN 5 THEN 'several lines need line ends' WHEN 6 THEN 'the sequence name holds white space' WHEN 7 THEN 'a field is negative' END AS error FROM l"
)
def index_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import fasta

    p, c = F.col("c_custkey") % 10, F.col("c_custkey")
    name = F.concat(F.when(p == 6, "a b").otherwise("s"), c)
    length, per = 100 + c, F.when(p == 3, 200 + c).when(p == 5, F.lit(60)).otherwise(60)
    width = F.when(p == 4, 59).when(p == 5, 60).when(p == 3, 201 + c).otherwise(61)
    line = F.concat_ws("\t", name, F.when(p == 2, "x").otherwise(length.cast("string")), F.when(p == 7, "-5").otherwise("5"), per.cast("string"), width.cast("string"))
    lines = _table(spark, sf_dir, "customer").select(F.lit("lines").alias("path"), c.alias("line_number"), F.when(p == 1, "a\t1").otherwise(line).alias("value"))
    return fasta.parse_index(lines).select("line_number", "error")


# Contracts of the other formats.
_OTHER = (
    "WITH a AS (SELECT 'p' || p_partkey AS name, p_size::BIGINT AS length, md5(p_name) AS md5 FROM part), d AS (SELECT 'p' || (p_partkey + 5) AS name, (p_size + CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END)::BIGINT AS length, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE md5(p_name) END AS md5 FROM part) "
)


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _table(spark, sf_dir, "part")
    k, md5 = F.col("p_partkey"), F.md5(F.col("p_name").cast("binary"))
    anchor = p.select(F.concat(F.lit("p"), k).alias("name"), k.alias("ordinal"), F.col("p_size").cast("long").alias("length"), md5.alias("md5"), F.lit(None).cast("string").alias("refget"))
    return anchor, p.select(F.concat(F.lit("p"), k + 5).alias("name"), k.alias("ordinal"), (F.col("p_size") + F.when(k % 8 == 0, 1).otherwise(0)).cast("long").alias("length"), F.when(k % 3 != 0, md5).alias("md5"))


@query(
    _OTHER + "SELECT 'presence' AS kind, d.name AS sequence_name, CASE WHEN a.name IS NULL THEN 'unresolved' ELSE 'satisfied' END AS state FROM d LEFT JOIN a USING (name) UNION ALL SELECT 'length', d.name, CASE WHEN a.name IS NULL THEN 'unresolved' WHEN a.length = d.length THEN 'satisfied' ELSE 'unsatisfied' END FROM d LEFT JOIN a USING (name) "
    "UNION ALL SELECT 'identity', d.name, CASE WHEN a.name IS NULL THEN 'unresolved' WHEN a.md5 = d.md5 THEN 'satisfied' ELSE 'unsatisfied' END FROM d LEFT JOIN a USING (name) WHERE d.md5 IS NOT NULL"
)
def alignment_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor, rows = _parts(spark, sf_dir)
    return evaluate.constraints("parts", contracts.alignment_contract("reads", rows), contracts.anchor_capabilities("parts", anchor, False)).select("kind", "sequence_name", "state")


_BOUNDS_STATE = "CASE WHEN count(*) = 0 THEN 'not_applicable' WHEN count(*) FILTER (WHERE state = 'out_of_bounds') > 0 THEN 'unsatisfied' WHEN count(*) FILTER (WHERE state = 'unresolved_sequence') > 0 THEN 'unresolved' ELSE 'satisfied' END"


@query(
    _INTERVALS + "SELECT 'presence' AS kind, sequence_name, CASE WHEN bool_or(anchor_length IS NOT NULL) THEN 'satisfied' ELSE 'unresolved' END AS state FROM c GROUP BY sequence_name UNION ALL SELECT 'bounds', NULL, " + _BOUNDS_STATE + " FROM c"
)
def interval_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = _lengths(spark, sf_dir)
    checked = bounds.check_intervals(_intervals(spark, sf_dir), anchor)
    count = bounds.capability(checked)
    requirements = contracts.interval_contract("intervals", "documents", bounds.interval_usage(_intervals(spark, sf_dir).withColumn("line_number", F.col("ordinal"))), count)
    capabilities = contracts.anchor_capabilities("documents", anchor, False).unionByName(contracts.check_capability("bounds", "intervals", "documents", count))
    return evaluate.constraints("documents", requirements, capabilities).select("kind", "sequence_name", "state")


@query(
    _FEATURES + "SELECT 'presence' AS kind, sequence_name, CASE WHEN bool_or(n IS NOT NULL) THEN 'satisfied' ELSE 'unresolved' END AS state FROM c GROUP BY sequence_name UNION ALL SELECT 'bounds', NULL, "
    "CASE WHEN count(*) FILTER (WHERE state = 'out_of_bounds') > 0 THEN 'unsatisfied' WHEN count(*) FILTER (WHERE state IN ('unresolved_sequence', 'circular_bounds_unresolved')) > 0 THEN 'unresolved' ELSE 'satisfied' END FROM c"
)
def annotation_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, marks, anchor = _features(spark, sf_dir)
    anchor = anchor.withColumn("ordinal", F.lit(None).cast("long"))
    checked = bounds.check_features(features, anchor, marks=bounds.landmarks(marks, anchor))
    count = bounds.capability(checked)
    requirements = contracts.annotation_contract("genes", "customers", bounds.usage(features), count=count)
    capabilities = contracts.anchor_capabilities("customers", anchor, False).unionByName(contracts.check_capability("bounds", "genes", "customers", count))
    return evaluate.constraints("customers", requirements, capabilities).select("kind", "sequence_name", "state")


@query(
    _BUNDLE + "SELECT 'constraint-requirement' AS edge, requirement_id AS id FROM z WHERE kind = 'length' "
    "UNION ALL SELECT 'constraint-cited', 'reference-base-capability:' || sha256('[\"calls\",\"documents\",' || checked || ',' || conflict || ',' || unresolved || ']') FROM t WHERE conflict > 0 "
    "UNION ALL SELECT 'constraint-candidate', 'reference-base-capability:' || sha256('[\"calls\",\"documents\",' || checked || ',' || conflict || ',' || unresolved || ']') FROM t "
    "UNION ALL SELECT 'evidence-capability', 'reference-base-capability:' || sha256('[\"calls\",\"documents\",' || checked || ',' || conflict || ',' || unresolved || ']') FROM t WHERE conflict > 0"
)
def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a bundle whose requirements lost their lengths and whose capabilities lost the check of the bases."""
    from anchorage.plans import report

    requirements, capabilities = _bundle(spark, sf_dir)
    return report.broken_references(evaluate.reason("documents", requirements, capabilities), requirements.where("kind <> 'length'"), capabilities.where("kind <> 'bases'"))


# A FASTA file of the customers, written to the shared folder and read back.
_FILE = (
    "WITH f AS (SELECT c_custkey AS k, 'c' || c_custkey AS name, '>c' || c_custkey || ' ' || c_name AS head, repeat('ACgtN', (1 + c_custkey % 50)::INTEGER) AS bases FROM customer), "
    "b AS (SELECT *, octet_length(head::BLOB) + 1 AS head_bytes, length(bases) + ceil(length(bases) / 60.0)::BIGINT AS body_bytes FROM f), "
    "o AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS ordinal, coalesce(sum(head_bytes + body_bytes) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head_bytes AS start_ FROM b) "
)


def _fasta_file(spark: SparkSession, sf_dir: str) -> str:
    bases = F.repeat(F.lit("ACgtN"), (1 + F.col("c_custkey") % 50).cast("int"))
    lines = F.transform(F.sequence(F.lit(0), F.ceil(F.length(bases) / 60).cast("int") - 1), lambda i: F.substring(bases, i * 60 + 1, F.lit(60)))
    head = F.concat(F.lit(">c"), "c_custkey", F.lit(" "), "c_name")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.concat(F.array(head), lines)).alias("at", "value"))
    folder = scratch_path(spark, "fasta")
    rows.coalesce(1).sortWithinPartitions("c_custkey", "at").select("value").write.text(folder)  # one file
    return spark.read.text(folder).inputFiles()[0]


@query(_FILE + "SELECT ordinal::BIGINT AS ordinal, name, length(bases)::BIGINT AS length, start_::BIGINT AS offset, least(60, length(bases))::BIGINT AS line_bases, (least(60, length(bases)) + 1)::BIGINT AS line_bytes FROM o")
def file_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import fasta

    return fasta.expected_index(spark, _fasta_file(spark, sf_dir))


@query(_FILE + "SELECT ordinal::BIGINT AS ordinal, name, length(bases)::BIGINT AS length, md5(upper(bases)) AS md5 FROM o")
def file_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import fasta

    return fasta.file_identities(spark, _fasta_file(spark, sf_dir)).select("ordinal", "name", "length", "md5")


@query(_FILE + "SELECT name, (unnest(range(0, ((length(bases) - 1) // 100 + 1)::BIGINT)))::BIGINT AS number, length(bases)::BIGINT AS length FROM o")
def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anchorage.sources import fasta

    return fasta.chunks(spark, _fasta_file(spark, sf_dir), 100).select("name", "number", "length")


FLAGSHIP = refbase_by_sequence
