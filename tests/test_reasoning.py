import itertools
import json

import pytest

from anchorage.errors import EvaluationError, ParseError
from anchorage.operators import alignment, collections, resolve
from anchorage.plans import bundle, contracts, derive, evaluate, profile, report
from anchorage.plans.model import BINDING, CAPABILITY, REQUIREMENT
from anchorage.sources import snapshot

ANCHOR = "name string, ordinal long, length long, md5 string, refget string"


def ddl(schema):
    return ", ".join(f"{k} {v}" for k, v in schema.items())


def rows_of(spark, schema, *rows):
    return spark.createDataFrame([tuple(r.get(k) for k in schema) for r in rows], ddl(schema))


def brute_resolution(local, anchor, scope):
    """The decision table, name by name."""
    out = {}
    complete = {s: bool(anchor) and all(a[k] is not None for a in anchor) for s, k in (("md5", 3), ("refget", 4))}
    for name in {n for n, _, _ in local}:
        values = {(s, v) for n, s, v in local if n == name}
        if len({s for s, _ in values}) < len(values):
            out[name] = ("unresolved", None)
            continue

        def hits(s, v):
            return {a[0] for a in anchor if a[3 if s == "md5" else 4] == v}

        found = set().union(*[hits(s, v) for s, v in values if complete.get(s)] or [set()])
        every = set().union(*[hits(s, v) for s, v in values] or [set()])
        if len(found) == 1:
            target = next(a for a in anchor if a[0] in found)
            wrong = any(target[3 if s == "md5" else 4] not in (None, v) for s, v in values)
            out[name] = ("matched", target[0]) if every == found and not wrong and (scope is None or target[0] in scope) else ("unresolved", None)
        elif found or every:
            out[name] = ("unresolved", None)
        else:
            out[name] = ("proven_absent", None) if any(complete.get(s) for s, _ in values) else ("unresolved", None)
    return out


@pytest.mark.parametrize("scope", [None, ("a", "c")])
@pytest.mark.parametrize(
    "anchor",
    [
        [("a", 0, 1, "m1", "r1"), ("b", 1, 1, "m2", "r2"), ("c", 2, 1, "m3", "r3")],
        [("a", 0, 1, "m1", "r1"), ("b", 1, 1, "m1", "r2"), ("c", 2, 1, "m3", "r3")],
        [("a", 0, 1, "m1", None), ("b", 1, 1, "m2", "r2"), ("c", 2, 1, "m3", "r3")],
        [("a", 0, 1, "m1", None), ("b", 1, 1, None, None), ("c", 2, 1, "m3", None)],
        [("a", 0, 1, "m1", "r1"), ("b", 1, 1, "m2", "r1"), ("c", 2, 1, None, "r3")],
    ],
)
def test_identity_resolution_table(spark, anchor, scope):
    local = []
    options = [None, "1", "2", "3", "9"]
    for m, r in itertools.product(options, options):
        name = f"n{m}{r}"
        local += [(name, "md5", f"m{m}")] * (m is not None) + [(name, "refget", f"r{r}")] * (r is not None)
    local += [("two", "md5", "m1"), ("two", "md5", "m9")]
    table = spark.createDataFrame(anchor, ANCHOR)
    picked = None if scope is None else spark.createDataFrame([(s,) for s in scope], "name string")
    got = {r["local_name"]: (r["state"], r["anchor_name"]) for r in resolve.resolve_identities(spark.createDataFrame(local, "local_name string, scheme string, value string"), table, picked).collect()}
    assert got == brute_resolution(local, anchor, scope)


def test_declared_bindings_need_length_and_use(spark):
    anchor = spark.createDataFrame([("chr1", 0, 4, "m1", None), ("chr2", 1, 5, "m2", None), ("chr3", 2, 5, "m2", None)], ANCHOR)
    declared = spark.createDataFrame([("1", None, "m1"), ("one", 4, "m1"), ("2", 5, "m2"), ("x", 9, "m1"), ("chr1", 4, "m1")], "name string, length long, md5 string")
    used = spark.createDataFrame([("1",), ("x",)], "sequence_name string")

    def names(**more):
        return {r["local_name"] for r in resolve.declared_bindings(declared, anchor, **more).collect()}

    assert names() == {"1", "one"} and names(need_length=True) == {"one"} and names(used=used) == {"1"}
    gap = anchor.unionByName(spark.createDataFrame([("chr4", 3, 1, None, None)], ANCHOR))
    assert resolve.declared_bindings(declared, gap).count() == 0


def test_absence_is_shown_once(spark):
    anchor = spark.createDataFrame([("chr1", 0, 4, "m1", None)], ANCHOR)
    local = spark.createDataFrame([("chr1", "md5", "m9", "content_derived"), ("z", "md5", "m8", "content_derived"), ("y", "md5", "m7", "declared_metadata")], "local_name string, scheme string, value string, provenance string")
    wanted = spark.createDataFrame([("chr1",), ("z",), ("y",)], "sequence_name string")
    assert {r[0] for r in resolve.identity_absences(local, anchor, wanted).collect()} == {"chr1", "z"}
    assert {r[0] for r in resolve.identity_absences(local, anchor, wanted, wanted).collect()} == {"z"}


def _world(spark):
    anchor = spark.createDataFrame([("chr1", 0, 10, "a" * 32, None), ("chr2", 1, 20, "b" * 32, None)], ANCHOR)
    return anchor, contracts.anchor_capabilities("ref", anchor)


def _states(spark, requirements, capabilities, bindings=None):
    return {r["requirement_id"]: (r["state"], r["mode"]) for r in evaluate.constraints("ref", requirements, capabilities, bindings).collect()}


def test_states_of_every_kind(spark):
    _, caps = _world(spark)
    base = {"resource_id": "c", "level": "mandatory", "origin": "core_format"}
    req = rows_of(
        spark, REQUIREMENT,
        base | {"requirement_id": "p1", "kind": "presence", "sequence_name": "chr1"}, base | {"requirement_id": "p2", "kind": "presence", "sequence_name": "chrX"}, base | {"requirement_id": "p3", "kind": "presence", "sequence_name": "1"},
        base | {"requirement_id": "p4", "kind": "presence", "sequence_name": "gone"}, base | {"requirement_id": "l1", "kind": "length", "sequence_name": "chr1", "length": 10}, base | {"requirement_id": "l2", "kind": "length", "sequence_name": "chr1", "length": 11},
        base | {"requirement_id": "l3", "kind": "length", "sequence_name": "1", "length": 10}, base | {"requirement_id": "i1", "kind": "identity", "sequence_name": "chr2", "scheme": "md5", "value": "b" * 32},
        base | {"requirement_id": "i2", "kind": "identity", "sequence_name": "chr2", "scheme": "md5", "value": "c" * 32}, base | {"requirement_id": "i3", "kind": "identity", "sequence_name": "chr2", "scheme": "refget", "value": "SQ.x"},
        base | {"requirement_id": "o1", "kind": "order", "names": ["chr1", "chr2"]}, base | {"requirement_id": "o2", "kind": "order", "names": ["chr2", "chr1"]},
        base | {"requirement_id": "b1", "kind": "bounds", "anchor_id": "ref", "count": 5}, base | {"requirement_id": "b2", "kind": "bounds", "anchor_id": "ref", "count": 6}, base | {"requirement_id": "r1", "kind": "bases", "anchor_id": "ref", "count": 0},
        base | {"requirement_id": "n1", "kind": "binding", "sequence_name": "1", "anchor_id": "ref"}, base | {"requirement_id": "n2", "kind": "binding", "sequence_name": "2", "anchor_id": "ref"},
    )
    checks = rows_of(
        spark, CAPABILITY,
        {"capability_id": "k1", "kind": "bounds", "subject_id": "c", "anchor_id": "ref", "checked": 5, "conflict": 0, "unresolved": 1}, {"capability_id": "k2", "kind": "bases", "subject_id": "c", "anchor_id": "ref", "checked": 0, "conflict": 0, "unresolved": 0},
        {"capability_id": "k3", "kind": "absence", "subject_id": "c", "sequence_name": "gone", "present": False}, {"capability_id": "k4", "kind": "binding", "subject_id": "c", "sequence_name": "1", "binding_state": "bound"},
        {"capability_id": "k5", "kind": "binding", "subject_id": "c", "sequence_name": "2", "binding_state": "content_conflict"}, {"capability_id": "k6", "kind": "identity", "subject_id": "ref", "sequence_name": "chr2", "scheme": "refget", "value": "SQ.x", "provenance": "declared_metadata"},
    )
    bound = contracts.binding_table("c", "ref", spark.createDataFrame([("1", "chr1", "verified_sequence_identity", ["md5:" + "a" * 32])], "local_name string, anchor_name string, method string, identity_values array<string>"))
    assert _states(spark, req, caps.unionByName(checks), bound) == {
        "p1": ("satisfied", "exact"), "p2": ("unresolved", None), "p3": ("satisfied", "verified_alias"), "p4": ("unsatisfied", None), "l1": ("satisfied", "exact"), "l2": ("unsatisfied", None), "l3": ("satisfied", "verified_alias"),
        "i1": ("satisfied", "verified_sequence_identity"), "i2": ("unsatisfied", None), "i3": ("unresolved", None), "o1": ("satisfied", "exact"), "o2": ("unsatisfied", None), "b1": ("unresolved", None), "b2": ("unresolved", None),
        "r1": ("not_applicable", None), "n1": ("satisfied", "verified_sequence_binding"), "n2": ("unsatisfied", None),
    }


def test_contradicting_lengths_are_unresolved(spark):
    _, caps = _world(spark)
    other = rows_of(spark, CAPABILITY, {"capability_id": "x", "kind": "length", "subject_id": "ref", "sequence_name": "chr1", "length": 11})
    req = rows_of(spark, REQUIREMENT, {"requirement_id": "l", "resource_id": "c", "kind": "length", "level": "mandatory", "sequence_name": "chr1", "length": 10})
    assert _states(spark, req, caps.unionByName(other))["l"][0] == "unresolved"


@pytest.mark.parametrize(
    ("states", "conditions", "value"),
    [
        ("", 0, "indeterminate"), ("n", 0, "indeterminate"), ("s", 0, "compatible"), ("sn", 0, "compatible"), ("s", 1, "compatible_with_conditions"), ("su", 1, "indeterminate"), ("sux", 0, "incompatible"), ("sX", 0, "compatible"), ("sU", 0, "compatible"), ("S", 0, "indeterminate"),
    ],
)
def test_verdicts(spark, states, conditions, value):
    names = {"s": "satisfied", "u": "unresolved", "x": "unsatisfied", "n": "not_applicable"}
    rows = [(f"c{i}", "advisory" if s.isupper() else "mandatory", names[s.lower()]) for i, s in enumerate(states)]
    judged = spark.createDataFrame(rows, "constraint_id string, level string, state string")
    assert derive.verdict(judged, judged, conditions).first()["verdict"] == value


def _reasoned(spark, length=10):
    _, caps = _world(spark)
    usage = spark.createDataFrame([("chr1",)], "sequence_name string")
    contigs = spark.createDataFrame([("chr1", length, "A" * 32), ("chr2", 1, None)], "name string, length long, md5 string")
    count = spark.createDataFrame([(4, 0, 0)], "checked long, conflict long, unresolved long")
    req = contracts.variant_contract("calls", "ref", usage, contigs, count)
    caps = caps.unionByName(contracts.check_capability("bases", "calls", "ref", count))
    return req, caps, evaluate.reason("ref", req, caps)


def test_bundle_report(spark):
    req, caps, tables = _reasoned(spark)
    assert req.count() == 4  # presence, length, identity of the used contig; bases
    request = report.Request((report.Resource("ref", "fasta", "/data/ref.fa"), report.Resource("calls", "vcf")), "ref")
    good = report.Report(request, result=report.collect(tables, req, caps))
    assert good.verdict == "compatible" and report.exit_code(good) == 0
    doc = json.loads(report.to_json(good))
    assert doc["report_format"]["schema_version"] == "3.0.0" and "/data" not in report.to_json(good)
    assert list(doc) == sorted(doc) and len(doc["scientific_result"]["evaluations"]) == 4
    said = report.to_text(good)
    assert said.startswith("Can these files share the coordinates of ref?  Compatible.") and "ref: ref.fa, fasta, the anchor" in said and "4 satisfied" in said and "/data" not in said
    kinds = {x["type"]: x for x in doc["scientific_result"]["requirements"]}
    assert kinds["sequence_length"]["length"] == 10 and kinds["sequence_identity"]["value"] == "a" * 32 and kinds["reference_bases"]["record_count"] == 4 and "value" not in kinds["sequence_length"]
    assert report.broken_references(tables, req, caps).count() == 0
    req, caps, tables = _reasoned(spark, 11)
    bad = report.Report(request, result=report.collect(tables, req, caps))
    assert report.exit_code(bad) == 1 and len(bad.result["conflict_cores"]) == 1
    assert bad.result["findings"][0]["kind"] == "sequence_length_conflict"
    assert "sequence length conflict: calls asks for sequence length of chr1" in report.to_text(bad) and "exact typed constraint" in report.to_text(bad)
    assert report.broken_references(tables, req.where("kind <> 'length'"), caps).count() == 1


def test_resources_are_described_by_their_bytes(spark, tmp_path):
    import hashlib

    path = tmp_path / "x.vcf"
    path.write_bytes(b"abc" * 700_000)
    found = report.described(spark, "calls", "vcf", str(path))
    assert found.byte_size == 2_100_000 and found.digest == ("sha256", hashlib.sha256(path.read_bytes()).hexdigest())
    doc = report.payload(report.Report(report.Request((report.Resource("ref", "fasta"), found), "ref"), "invalid_input", [{"kind": "k", "message": "m"}]))
    assert doc["request"]["resources"][1]["artifact"]["byte_size"] == 2_100_000


def test_report_rules():
    request = report.Request((report.Resource("ref", "fasta"),), "ref")
    issue = {"kind": "invalid_input", "message": "x"}
    assert report.exit_code(report.Report(request, "invalid_input", [issue])) == 2
    for status, issues, result in (("complete", [issue], None), ("invalid_input", [], None), ("partial", [issue], {"verdict": {"value": "compatible"}})):
        with pytest.raises(ValueError, match="report|input"):
            report.Report(request, status, issues, result)
    with pytest.raises(ValueError, match="anchor"):
        report.Request((report.Resource("v", "vcf"),), "v")


def test_requirement_ids_are_stable(spark):
    import hashlib

    req, _, _ = _reasoned(spark)
    found = {r["requirement_id"] for r in req.where("kind = 'presence'").collect()}
    assert found == {"vcf-requirement:" + hashlib.sha256(b'["presence","calls","chr1"]').hexdigest()}


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("chr1", 0, 10, "a"), ("chr2", 1, 20, "b")], ("exact", "exact", "consistent", "m5_verified", "use_explicit_local_anchor")),
        ([("chr2", 0, 20, "b")], ("alignment_subset", "exact", "consistent", "m5_verified", "use_explicit_local_anchor")),
        ([("chr2", 0, 20, "b"), ("chr1", 1, 10, "a")], ("exact", "exact", "different", "m5_verified", "use_explicit_local_anchor")),
        ([("chr1", 0, 10, "a"), ("chr2", 1, 20, "b"), ("new", 2, 5, "z")], ("alignment_superset", "exact", "consistent", "m5_verified", "defer_reference_dependent_decoding")),
        ([("chr1", 0, 10, None)], ("alignment_subset", "exact", "consistent", "unresolved", "defer_reference_dependent_decoding")),
        ([("chr1", 0, 11, "c")], ("alignment_subset", "exact", "consistent", "m5_conflict", "defer_reference_dependent_decoding")),
        ([("new", 0, 5, None)], ("unresolved", "unresolved", "unresolved", "unresolved", "defer_reference_dependent_decoding")),
        ([("1", 0, 10, "a")], ("alignment_subset", "verified_difference", "consistent", "m5_verified", "defer_reference_dependent_decoding")),
    ],
)
def test_alignment_relations(spark, rows, want):
    anchor = spark.createDataFrame([("chr1", 0, 10, "a", None), ("chr2", 1, 20, "b", None)], ANCHOR)
    table = spark.createDataFrame(rows, "name string, ordinal long, length long, md5 string")
    found = alignment.resolve_dictionary(table, anchor, resolve.declared_bindings(table, anchor, need_length=True))
    r = alignment.offline_reference(alignment.relationship(found, anchor), True).first()
    assert (r["membership"], r["naming"], r["order"], r["content"], r["action"]) == want


def test_differences_of_equal_names(spark):
    e = spark.createDataFrame([("a", 0, 1, None), ("b", 1, 2, "m")], "name string, ordinal long, length long, md5 string")
    assert collections.dictionary_differences(e, e).count() == 0
    assert [r["kind"] for r in collections.dictionary_differences(e, e.where("name = 'a'")).orderBy("kind").collect()] == ["missing_sequence", "record_count"]


def _snapshot(**more):
    when, source = "2026-01-01T00:00:00+01:00", {"database_id": "db", "context_id": "c", "locator": "x"}
    doc = {
        "schema": snapshot.SCHEMA, "database_id": "db", "context_id": "c", "completeness": dict.fromkeys(snapshot.DIMENSIONS, "complete"),
        "sources": [source | {"id": d, "acquired_at": when, "dimensions": [d]} for d in snapshot.DIMENSIONS],
        "sequences": [
            {"canonical_name": n, "length": size, "catalog_source_ids": ["sequence_catalog"], "refget_id": None, "md5": m, "identity_source_ids": ["content_identity"] if m else []}
            for n, size, m in (("one", 10, "a" * 32), ("two", 21, "b" * 32), ("none", 5, "9" * 32), ("bare", 5, None))
        ],
        "aliases": [{"alias": a, "canonical_name": n, "source_ids": ["aliases"], "authority": "x"} for a, n in (("1", "one"), ("both", "one"), ("both", "two"))],
    }
    return doc | more


def test_profile_outcomes(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(_snapshot()))
    snap = snapshot.load(spark, str(path))
    anchor = spark.createDataFrame([("chr1", 0, 10, "a" * 32, None), ("chr2", 1, 20, "b" * 32, None)], ANCHOR)
    names = ["one", "1", "two", "none", "bare", "both", "huh"]
    required = spark.createDataFrame([("r", n, True) for n in names], "resource_id string, local_name string, mandatory boolean")
    bindings = spark.createDataFrame([("r", "1", "chr1")], "resource_id string, local_name string, anchor_name string")
    ids = spark.createDataFrame([], "local_name string, scheme string, value string")
    got = {r["local_name"]: (r["outcome"], r["reason"]) for r in profile.project(snap, required, "ref", anchor, bindings, ids).collect()}
    assert got == {
        "one": ("new_binding", "content_bound"), "1": ("bound", "content_bound"), "two": ("unresolved", "provider_length_conflict"), "none": ("proven_absent", "exhaustive_content_absence"),
        "bare": ("unresolved", "content_identity_unavailable"), "both": ("unresolved", "ambiguous_alias"), "huh": ("unresolved", "undeclared_name"),
    }
    other = spark.createDataFrame([("r", "1", "chr2")], "resource_id string, local_name string, anchor_name string")
    found = profile.project(snap, required, "ref", anchor, other, ids)
    assert found.where("local_name = '1'").first()["outcome"] == "content_conflict"
    assert profile.capabilities(found, snap, "ref").where("sequence_name = '1'").first()["binding_state"] == "content_conflict"
    assert profile.new_bindings(found).count() == 1
    assert {r["outcome"] for r in profile.project(None, required, "ref", anchor, bindings, ids).collect()} == {"unresolved"}
    against = spark.createDataFrame([("one", "md5", "f" * 32)], "local_name string, scheme string, value string")
    assert profile.project(snap, required, "ref", anchor, bindings, against).where("local_name = 'one'").first()["outcome"] == "unresolved"


def test_snapshot_rules():
    good = json.dumps(_snapshot()).encode()
    assert json.loads(snapshot.render(snapshot.parse(good)))["sources"][0]["acquired_at"] == "2025-12-31T23:00:00+00:00"
    bad = [good.replace(b'"database_id"', b'"database_id": 1, "database_id"', 1), good[:-2], json.dumps(_snapshot(extra=1)).encode(), json.dumps(_snapshot(schema="other")).encode(), good.replace(b"+01:00", b"", 1), good.replace(b'"alias": "1", "canonical_name": "one"', b'"alias": "1", "canonical_name": "no"')]
    for data in bad:
        with pytest.raises(ParseError):
            snapshot.parse(data)
    with pytest.raises(ParseError):
        snapshot.parse(good, expected_sha256="0" * 64)


def test_conditions():
    found = derive.conditions(["ref", "a"], ["ref", "a", "b"], ["chr1"], "ref", ["k"])
    assert [c["kind"] for c in found] == ["explicit_resource_scope", "explicit_anchor_sequence_scope"]
    assert derive.conditions(["ref"], ["ref"], None, "ref", []) == []


def test_binding_ids_follow_their_facts(spark):
    made = contracts.binding_table("r", "ref", spark.createDataFrame([("1", "chr1", "verified_sequence_identity", ["md5:x"]), ("2", "chr1", "authoritative_name", None)], "local_name string, anchor_name string, method string, identity_values array<string>"))
    assert made.columns == list(BINDING) and made.select("binding_id").distinct().count() == 2


IDS = "resource_id string, local_name string, scheme string, value string, provenance string"


def _required(spark, *rows):
    base = {"level": "mandatory", "origin": "core_format"}
    return rows_of(spark, REQUIREMENT, *[base | {"requirement_id": f"q{i}"} | r for i, r in enumerate(rows)])


def test_bundle_binds_by_content_and_proves_absence(spark):
    anchor = spark.createDataFrame([("chr1", 0, 10, "a" * 32, None), ("chr2", 1, 20, "b" * 32, None)], ANCHOR)
    ids = spark.createDataFrame([("x", "1", "md5", "a" * 32, "content_derived"), ("y", "1", "md5", "9" * 32, "content_derived"), ("x", "2", "md5", "9" * 32, "declared_metadata")], IDS)
    req = _required(spark, {"resource_id": "x", "kind": "presence", "sequence_name": "1"}, {"resource_id": "y", "kind": "presence", "sequence_name": "1"}, {"resource_id": "x", "kind": "presence", "sequence_name": "2"}, {"resource_id": "x", "kind": "length", "sequence_name": "1", "length": 10})
    out = bundle.reason_bundle("ref", anchor, req, ids)
    assert {(r["resource_id"], r["sequence_name"], r["kind"]): r["state"] for r in out["constraints"].collect()} == {("x", "1", "presence"): "satisfied", ("y", "1", "presence"): "unsatisfied", ("x", "2", "presence"): "unresolved", ("x", "1", "length"): "satisfied"}
    assert out["verdict"].first()["verdict"] == "incompatible"
    assert {r["method"] for r in out["evidence"].where("polarity = 'contradicts'").collect()} == {"exhaustive_sequence_identity_absence"}
    assert report.broken_references(out, out["requirements"], out["capabilities"]).count() == 0
    only = bundle.reason_bundle("ref", anchor, req, ids, scope=["x"], excluded=1)
    assert only["verdict"].first()["verdict"] == "indeterminate" and only["constraints"].count() == 3


def test_scope_limits_names_but_not_uniqueness(spark):
    anchor = spark.createDataFrame([("chr1", 0, 10, "a" * 32, None), ("chr2", 1, 20, "a" * 32, None)], ANCHOR)
    ids = spark.createDataFrame([("x", "1", "md5", "a" * 32, "content_derived")], IDS)
    req = _required(spark, {"resource_id": "x", "kind": "presence", "sequence_name": "1"}, {"resource_id": "x", "kind": "presence", "sequence_name": "chr1"})
    picked = spark.createDataFrame([("chr1",)], "name string")
    out = bundle.reason_bundle("ref", anchor, req, ids, selected=picked)
    assert {r["sequence_name"]: r["state"] for r in out["constraints"].collect()} == {"1": "unresolved", "chr1": "satisfied"}
    with pytest.raises(EvaluationError):
        bundle.reason_bundle("ref", anchor, req, ids, selected=spark.createDataFrame([("no",)], "name string"))


def test_supplements_must_be_asked_for(spark):
    anchor = spark.createDataFrame([("chr1", 0, 10, "a" * 32, None)], ANCHOR)
    req = _required(spark, {"resource_id": "x", "kind": "bases", "anchor_id": "ref", "count": 5}, {"resource_id": "x", "kind": "binding", "anchor_id": "ref", "sequence_name": "1"})
    count = spark.createDataFrame([(5, 0, 0)], "checked long, conflict long, unresolved long")
    good = contracts.check_capability("bases", "x", "ref", count)
    named = rows_of(spark, BINDING, {"binding_id": "b", "resource_id": "x", "local_name": "1", "anchor_id": "ref", "anchor_name": "chr1", "method": "authoritative_name"})
    told = rows_of(spark, CAPABILITY, {"capability_id": "k", "kind": "binding", "resource_id": "ref", "subject_id": "x", "sequence_name": "1", "binding_state": "bound"})
    out = bundle.reason_bundle("ref", anchor, req, supplements=good.unionByName(told), supplemental_bindings=named)
    assert out["verdict"].first()["verdict"] == "compatible"
    for caps, bound in ((good, named), (good.unionByName(told), None), (contracts.check_capability("bases", "z", "ref", count), None), (good.unionByName(good), None), (contracts.check_capability("bounds", "x", "ref", count), None), (contracts.anchor_capabilities("ref", anchor, False), None)):
        with pytest.raises(EvaluationError):
            bundle.reason_bundle("ref", anchor, req, supplements=caps, supplemental_bindings=bound)


def test_fetch_over_chunks(spark):
    from anchorage.operators import refbases

    text = "ACGTTGCAAC"
    bases = spark.createDataFrame([("s", text)], "name string, sequence string")
    spans = [(i, "s", a, b) for i, (a, b) in enumerate(itertools.product(range(-1, 12), repeat=2))] + [(999, "no", 0, 1)]
    wanted = spark.createDataFrame(spans, "span_id long, name string, start long, end long")
    got = {r["span_id"]: r["bases"] for r in refbases.fetch(refbases.chunked(bases, 3), wanted, 3).collect()}
    assert got == {i: text[a:b] if n == "s" and 0 <= a <= b <= 10 else None for i, n, a, b in spans}


def test_annotation_identities_are_of_used_names(spark):
    usage = spark.createDataFrame([("a",)], "sequence_name string")
    embedded = spark.createDataFrame([("a", "m1"), ("b", "m2")], "sequence_name string, md5 string")
    supplied = spark.createDataFrame([("a", "refget", "r", "content_derived"), ("a", "md5", "z", "declared_metadata")], "local_name string, scheme string, value string, provenance string")
    got = {(r["scheme"], r["value"]) for r in contracts.annotation_identities("x", usage, embedded, supplied).collect()}
    assert got == {("md5", "m1"), ("refget", "r")}


def test_orders_are_projected_and_compared_whole(spark):
    _, caps = _world(spark)
    base = {"resource_id": "c", "level": "mandatory", "origin": "core_format", "kind": "order"}
    req = rows_of(
        spark, REQUIREMENT,
        base | {"requirement_id": "part", "names": ["chr2"]}, base | {"requirement_id": "alias", "names": ["1", "2"]}, base | {"requirement_id": "mixed", "names": ["1", "chr2"]}, base | {"requirement_id": "back", "names": ["2", "1"]},
        base | {"requirement_id": "unknown", "names": ["chr1", "chr3"]}, base | {"requirement_id": "plain", "names": ["chr1", "chr2"]}, base | {"requirement_id": "other", "resource_id": "d", "names": ["1", "2"]},
    )
    bound = contracts.binding_table(
        "c", "ref", spark.createDataFrame([("1", "chr1", "verified_sequence_identity", ["md5:" + "a" * 32]), ("2", "chr2", "verified_sequence_identity", ["md5:" + "b" * 32])], "local_name string, anchor_name string, method string, identity_values array<string>")
    )
    assert _states(spark, req, caps, bound) == {
        "part": ("unsatisfied", None), "alias": ("satisfied", "verified_alias"), "mixed": ("satisfied", "verified_alias"), "back": ("unsatisfied", None), "unknown": ("unresolved", None), "plain": ("satisfied", "exact"), "other": ("unresolved", None),
    }
    rows = {r["requirement_id"]: r for r in evaluate.constraints("ref", req, caps, bound).collect()}
    assert len(rows["alias"]["binding_ids"]) == 2 and len(rows["mixed"]["binding_ids"]) == 1 and rows["plain"]["binding_ids"] == [] and rows["unknown"]["candidate_ids"] == []
    two = caps.unionByName(rows_of(spark, CAPABILITY, {"capability_id": "x", "kind": "order", "subject_id": "ref", "names": ["chr2", "chr1"]}))
    assert _states(spark, req, two, bound)["plain"] == ("unresolved", None) and _states(spark, req, two, bound)["part"] == ("unsatisfied", None)


def test_equal_records_over_a_border_are_all_kept(spark):
    from anchorage.operators import refbases

    bases = spark.createDataFrame([("s", "ACGTACGTAC")], "name string, sequence string")
    rows = [("s", 4, "TA")] * 3 + [("s", 1, "AC")] * 2 + [("s", 3, "GTACGT")] * 2 + [("s", 4, "TT"), ("s", 10, "CA"), ("x", 1, "A"), ("s", 0, "A")]
    records = spark.createDataFrame(rows, "sequence_name string, position long, ref string")
    for chunk in (1, 2, 4, 16):
        got = refbases.check_chunked(records, refbases.chunked(bases, chunk), chunk).drop("found", "anchor_name").collect()
        want = refbases.check(records, bases).drop("found", "anchor_name").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len(rows)


def test_profile_traces(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps(_snapshot()))
    snap = snapshot.load(spark, str(path))
    anchor = spark.createDataFrame([("chr1", 0, 10, "a" * 32, None), ("chr2", 1, 20, "b" * 32, None)], ANCHOR)
    required = spark.createDataFrame([("r", n, True) for n in ("one", "1", "none", "huh")], "resource_id string, local_name string, mandatory boolean")
    none = spark.createDataFrame([], "resource_id string, local_name string, anchor_name string")
    ids = spark.createDataFrame([], "local_name string, scheme string, value string")
    found = profile.project(snap, required, "ref", anchor, none, ids)
    told = profile.capabilities(found, snap, "ref")
    bound = bundle.derived_bindings("ref", anchor, spark.createDataFrame([("r", "1", "md5", "a" * 32)], "resource_id string, local_name string, scheme string, value string"))
    traced = {r["local_name"]: r for r in profile.trace(found, snap, bound, told).collect()}
    assert traced["one"]["name_sources"] == ["sequence_catalog"] and traced["1"]["name_sources"] == ["aliases"] and traced["none"]["content_sources"] == ["content_identity"] and traced["huh"]["name_sources"] == []
    assert traced["1"]["binding_id"] and traced["one"]["binding_id"] is None and traced["none"]["capability_id"] and traced["huh"]["capability_id"] is None
    context = profile.context(snap, "browser", "db", profile.trace(found, snap))
    assert [t["local_name"] for t in context["sequence_traces"]] == ["1", "huh", "none", "one"] and context["sources"][0]["acquired_at"].startswith("2025-12-31T23:00:00")
    absent = profile.context(None, "browser", "db", profile.trace(profile.project(None, required, "ref", anchor, none, ids), None))
    assert absent["sources"] == [] and {t["outcome"] for t in absent["sequence_traces"]} == {"unresolved"}
    req, caps, tables = _reasoned(spark)
    request = report.Request((report.Resource("ref", "fasta"), report.Resource("calls", "vcf")), "ref", profiles=("browser",))
    said = report.to_text(report.Report(request, result=report.collect(tables, req, caps, bound, profiles=[context])))
    assert "Profile browser for db" in said and "none of r: proven absent" in said and "1 of r is chr1" in said


def test_snapshots_render_alike_in_any_order():
    doc = _snapshot()
    turned = doc | {k: doc[k][::-1] for k in ("sources", "sequences", "aliases")}
    assert snapshot.render(snapshot.parse(json.dumps(doc).encode())) == snapshot.render(snapshot.parse(json.dumps(turned).encode()))


def test_a_variant_file_by_itself(spark):
    from anchorage.operators import refbases
    from anchorage.plans import projection

    anchor = spark.createDataFrame([("chr1", 0, 8, "a" * 32, None), ("chr2", 1, 4, "b" * 32, None)], ANCHOR)
    bases = spark.createDataFrame([("chr1", "ACGTACGT"), ("chr2", "TTTT")], "name string, sequence string")
    records = spark.createDataFrame([("1", 1, "A"), ("1", 2, "C"), ("chr2", 1, "A")], "sequence_name string, position long, ref string")
    usage = spark.createDataFrame([("1", 2), ("chr2", 1)], "sequence_name string, n_records long")
    contigs = spark.createDataFrame([("1", 8, "A" * 32), ("chr2", 4, None)], "name string, length long, md5 string")
    bound = spark.createDataFrame([("1", "chr1")], "local_name string, anchor_name string")
    outcomes = refbases.outcomes(refbases.check(records, bases, bound))
    found = projection.variant_projection("calls", "ref", anchor, usage, contigs, outcomes, validated=bound)
    states = {(r["kind"], r["sequence_name"]): r["state"] for r in found["constraints"].collect()}
    assert states == {("presence", "1"): "satisfied", ("presence", "chr2"): "satisfied", ("length", "1"): "satisfied", ("length", "chr2"): "satisfied", ("identity", "1"): "satisfied", ("bases", None): "unsatisfied"}
    assert found["verdict"].first()["verdict"] == "incompatible" and found["pattern"].first()["pattern"] == "isolated" and found["bindings"].first()["anchor_name"] == "chr1"
    with pytest.raises(EvaluationError, match="binding"):
        projection.variant_projection("calls", "ref", anchor, usage, contigs, outcomes)
    with pytest.raises(EvaluationError, match="records"):
        projection.variant_projection("calls", "ref", anchor, usage.selectExpr("sequence_name", "n_records + 1 as n_records"), contigs, outcomes, validated=bound)


def test_an_annotation_by_itself(spark):
    from anchorage.operators import bounds
    from anchorage.plans import projection

    anchor = spark.createDataFrame([("chr1", 0, 100, "a" * 32, None), ("chr2", 1, 50, "b" * 32, None)], ANCHOR)
    rows = [(0, "1", 5, 90), (1, "chr2", 1, 50), (2, "gone", 1, 5)]
    features = spark.createDataFrame([(k, k, n, "gene", a, b, False) for k, n, a, b in rows], "ordinal long, line_number long, sequence_name string, feature_type string, start long, end long, is_circular boolean")
    usage = bounds.usage(features)
    supplied = spark.createDataFrame([("1", "md5", "a" * 32, "content_derived"), ("gone", "md5", "f" * 32, "content_derived"), ("unused", "md5", "b" * 32, "content_derived")], "local_name string, scheme string, value string, provenance string")
    bound = spark.createDataFrame([("1", "chr1")], "local_name string, anchor_name string")
    outcomes = bounds.outcomes(bounds.check_features(features, anchor, bound))
    regions = spark.createDataFrame([("1", "representable")], "sequence_name string, state string")
    found = projection.annotation_projection("genes", "ref", anchor, usage, outcomes, regions=regions, supplied=supplied, validated=bound)
    states = {(r["kind"], r["sequence_name"]): (r["state"], r["mode"]) for r in found["constraints"].collect()}
    assert states == {("presence", "1"): ("satisfied", "verified_alias"), ("presence", "chr2"): ("satisfied", "exact"), ("presence", "gone"): ("unsatisfied", None), ("bounds", None): ("unresolved", None)}
    assert found["capabilities"].where("kind = 'bounds'").first()["checked"] == 4
    with pytest.raises(EvaluationError, match="binding"):
        projection.annotation_projection("genes", "ref", anchor, usage, outcomes, supplied=supplied)
