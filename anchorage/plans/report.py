"""Reports: one JSON document or text from the small tables of a bundle, and exit codes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.plans.model import RULES
from anchorage.sources.lines import opened

FORMAT, SCHEMA_VERSION, DRAFT_REVISION, TOOL_VERSION = "anchorage.compatibility_report", "3.0.0", 5, "0.1.0"
RESOURCE_KINDS = ("fasta", "fasta_index", "sequence_dictionary", "vcf", "bcf", "bed", "bam", "cram", "gtf", "gff3")
# Exit codes of a workflow.
EXIT = {"success": 0, "incompatible": 1, "invalid_input": 2, "indeterminate": 3, "partial": 4, "operational_failure": 5}
STATES = ("satisfied", "unsatisfied", "unresolved", "not_applicable")
# The keys of each kind of requirement and capability in a report, and the columns they come from.
REQUIREMENT_KEYS = {
    "presence": {"sequence_name": "sequence_name"}, "length": {"sequence_name": "sequence_name", "length": "length"}, "identity": {"sequence_name": "sequence_name", "algorithm": "scheme", "value": "value"},
    "order": {"sequence_names": "names"}, "binding": {"sequence_name": "sequence_name", "anchor_resource_id": "anchor_id"}, "bounds": {"anchor_resource_id": "anchor_id", "coordinate_count": "count"},
    "bases": {"anchor_resource_id": "anchor_id", "record_count": "count"},
}
CAPABILITY_KEYS = {
    "presence": {"sequence_name": "sequence_name", "present": "present"}, "length": {"sequence_name": "sequence_name", "length": "length"},
    "identity": {"sequence_name": "sequence_name", "algorithm": "scheme", "value": "value", "provenance": "provenance"}, "order": {"sequence_names": "names"},
    "binding": {"subject_resource_id": "subject_id", "sequence_name": "sequence_name", "state": "binding_state"}, "absence": {"subject_resource_id": "subject_id", "sequence_name": "sequence_name"},
    "bounds": {"subject_resource_id": "subject_id", "checked_count": "checked", "conflict_count": "conflict", "unresolved_count": "unresolved"},
    "bases": {"subject_resource_id": "subject_id", "checked_count": "checked", "mismatch_count": "conflict", "unresolved_count": "unresolved"},
}


@dataclass(frozen=True)
class Resource:
    id: str
    kind: str
    path: str | None = None
    display_name: str | None = None
    byte_size: int | None = None
    digest: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        if not self.id:
            raise ValueError("a resource needs an id")
        if self.kind not in RESOURCE_KINDS:
            raise ValueError(f"unknown resource kind {self.kind!r}")


def described(spark: SparkSession, ident: str, kind: str, path: str, display_name: str | None = None) -> Resource:
    """A resource with the size and SHA-256 of its file, read in blocks."""
    digest, size = hashlib.sha256(), 0
    with opened(spark, path, 1 << 20) as file:
        while block := file.read(1 << 20):
            digest.update(block)
            size += len(block)
    return Resource(ident, kind, path, display_name, size, ("sha256", digest.hexdigest()))


@dataclass(frozen=True)
class Request:
    resources: tuple[Resource, ...]
    anchor: str
    scope: tuple[str, ...] | None = None
    anchor_names: tuple[str, ...] | None = None
    profiles: tuple[str, ...] = ()
    policy: str | None = None

    def __post_init__(self) -> None:
        ids = [r.id for r in self.resources]
        if len(set(ids)) != len(ids):
            raise ValueError("resource ids are not distinct")
        kinds = {r.id: r.kind for r in self.resources}
        if kinds.get(self.anchor) != "fasta":
            raise ValueError("the anchor is one of the FASTA resources")
        if self.scope is not None and (not set(self.scope) <= set(ids) or self.anchor not in self.scope):
            raise ValueError("the scope holds resources of the request, the anchor among them")

    @property
    def scoped(self) -> tuple[str, ...]:
        return self.scope if self.scope is not None else tuple(r.id for r in self.resources)


@dataclass
class Report:
    """What a run found.  Invalid input carries no result; a partial run is never positive."""

    request: Request
    status: str = "complete"
    issues: list[dict] = field(default_factory=list)
    result: dict | None = None

    def __post_init__(self) -> None:
        value = self.result["verdict"]["value"] if self.result else None
        if self.status == "complete" and (self.result is None or self.issues):
            raise ValueError("a complete report has a result and no issues")
        if self.status == "invalid_input" and (self.result is not None or not self.issues):
            raise ValueError("invalid input has issues and no result")
        if self.status == "partial" and (not self.issues or (value or "").startswith("compatible")):
            raise ValueError("a partial report has issues and is not positive")

    @property
    def verdict(self) -> str | None:
        return self.result["verdict"]["value"] if self.result else None


def collect(tables: dict[str, DataFrame], requirements: DataFrame, capabilities: DataFrame, bindings: DataFrame | None = None, conditions: list[dict] | None = None, observations: list[dict] | None = None, relations: list[dict] | None = None, profiles: list[dict] | None = None) -> dict:
    """The result of a bundle as plain values.  These tables are as small as the lists of sequences they are about.

    Listed are the capabilities that constraints were judged by and, of each
    proven absence and each binding among them, the identities it rests on.
    """

    def rows(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    judged = sorted(rows(tables["constraints"]), key=lambda r: r["constraint_id"])
    evidence = sorted(rows(tables["evidence"]), key=lambda r: r["evidence_id"])
    findings = sorted(rows(tables["findings"]), key=lambda r: r["finding_id"])
    cores = sorted(rows(tables["cores"]), key=lambda r: r["core_id"])
    verdict = tables["verdict"].first()
    bound = sorted(rows(bindings), key=lambda r: r["binding_id"]) if bindings is not None else []
    caps = sorted(_closed(rows(capabilities), {c for r in judged for c in r["candidate_ids"]}, bound), key=lambda r: r["capability_id"])
    must = [r for r in judged if r["level"] == "mandatory"]

    def plain(r: dict, ident: str, keys: dict[str, dict[str, str]]) -> dict:
        kind = RULES.get(r["kind"], "sequence_identity_absence" if r["kind"] == "absence" else r["kind"])
        own = {k: r[c] for k, c in keys[r["kind"]].items()}
        return {"id": r[ident], "type": kind, "resource_id": r["resource_id"]} | ({"level": r["level"], "origin": r["origin"]} if "level" in r else {}) | own

    return {
        "alignment_relationships": relations or [],
        "capabilities": [plain(r, "capability_id", CAPABILITY_KEYS) for r in caps],
        "conditions": conditions or [],
        "conflict_cores": [{"id": r["core_id"], "kind": r["core_kind"], "constraint_ids": [r["constraint_id"]], "requirement_ids": [r["requirement_id"]], "finding_ids": [r["finding_id"]], "evidence_ids": r["evidence_ids"], "resource_ids": r["resource_ids"]} for r in cores],
        "constraints": [{"id": r["constraint_id"], "requirement_id": r["requirement_id"], "rule": RULES[r["kind"]], "candidate_capability_ids": r["candidate_ids"], "sequence_binding_ids": r["binding_ids"]} for r in judged],
        "evaluations": [{"constraint_id": r["constraint_id"], "requirement_id": r["requirement_id"], "state": r["state"], "satisfaction_mode": r["mode"], "relevant_capability_ids": r["cited_ids"]} for r in judged],
        "evidence": {
            "items": [
                {"id": r["evidence_id"], "constraint_id": r["constraint_id"], "requirement_id": r["requirement_id"], "capability_id": r["capability_id"], "kind": r["evidence_kind"], "method": r["method"], "strength": r["strength"], "polarity": r["polarity"], "sequence_binding_ids": r["binding_ids"]}
                for r in evidence
            ],
            "not_applicable_constraint_ids": [r["constraint_id"] for r in judged if r["state"] == "not_applicable"],
            "unresolved_constraint_ids": [r["constraint_id"] for r in judged if r["state"] == "unresolved"],
        },
        "findings": [{"id": r["finding_id"], "kind": r["finding_kind"], "constraint_ids": [r["constraint_id"]], "requirement_ids": [r["requirement_id"]], "evidence_ids": r["evidence_ids"], "resource_ids": r["resource_ids"]} for r in findings],
        "observations": observations or [],
        "profile_contexts": profiles or [],
        "requirements": sorted((plain(r, "requirement_id", REQUIREMENT_KEYS) for r in rows(requirements)), key=lambda r: r["id"]),
        "sequence_bindings": [
            {"id": b["binding_id"], "resource_id": b["resource_id"], "local_sequence_name": b["local_name"], "anchor_resource_id": b["anchor_id"], "anchor_sequence_name": b["anchor_name"], "method": b["method"], "identity_values": b["identity_values"] or []}
            for b in bound
        ],
        "verdict": {
            "value": verdict["verdict"],
            "basis_finding_ids": [r["finding_id"] for r in cores],
            "condition_ids": [c["condition_id"] for c in conditions or []],
            "mandatory_constraint_ids": [r["constraint_id"] for r in must],
            "constraint_states": {s: [r["constraint_id"] for r in must if r["state"] == s] for s in STATES},
        },
    }


def _closed(capabilities: list[dict], used: set[str], bindings: list[dict]) -> list[dict]:
    """The used capabilities and the anchor's identities behind bindings.  An absence rests on all identities of its anchor: that none is the missing one is what it says."""
    absent = {c["resource_id"] for c in capabilities if c["capability_id"] in used and c["kind"] == "absence"}
    named = {(b["anchor_id"], b["anchor_name"]) for b in bindings}
    return [c for c in capabilities if c["capability_id"] in used or c["kind"] == "identity" and (c["resource_id"] in absent or (c["resource_id"], c["sequence_name"]) in named)]


def payload(report: Report, draft: bool = False) -> dict:
    """The document; no local paths are in it."""
    q = report.request
    version = {"draft_revision": DRAFT_REVISION} if draft else {"schema_version": SCHEMA_VERSION}
    return {
        "analysis": {"status": report.status, "issues": report.issues},
        "report_format": {"name": FORMAT} | version,
        "request": {
            "active_profiles": list(q.profiles), "anchor_resource_id": q.anchor, "policy_id": q.policy,
            "resources": [{"id": r.id, "kind": r.kind, "display_name": r.display_name, "artifact": {"byte_size": r.byte_size, "digest": {"algorithm": r.digest[0], "value": r.digest[1]} if r.digest else None}} for r in q.resources],
            "scope": {"resource_ids": list(q.scoped), "anchor_sequence_names": list(q.anchor_names) if q.anchor_names is not None else None},
        },
        "scientific_result": report.result,
        "tool_version": TOOL_VERSION,
    }


def to_json(report: Report, draft: bool = False) -> str:
    return json.dumps(payload(report, draft), indent=2, sort_keys=True, ensure_ascii=False) + "\n"


def to_text(report: Report) -> str:
    """The same for people: the answer first, then what it rests on, then what it is about.  A part without entries is left out."""
    q, r = report.request, report.result
    kinds = {x.id: x for x in q.resources}
    answer = (report.verdict or "no verdict").replace("_", " ")
    lines = [f"Can these files share the coordinates of {q.anchor}?  {answer[0].upper()}{answer[1:]}.", ""]

    def part(title: str, entries: list[str]) -> None:
        if entries:
            lines.extend([f"{title} ({len(entries)})", *(f"  {e}" for e in entries), ""])

    if report.status != "complete":
        lines.insert(1, f"This run is not complete: {report.status.replace('_', ' ')}.")
    part("Problems met", [f"{i['kind'].replace('_', ' ')}: {i['message']}" for i in report.issues])
    if r:
        wanted = {x["id"]: x for x in r["requirements"]}

        def said(requirement: str) -> str:
            x = wanted.get(requirement)
            if x is None:
                return requirement
            what = x.get("sequence_name") or ", ".join(x.get("sequence_names") or []) or f"all {x.get('record_count', x.get('coordinate_count', ''))} records"
            return f"{x['resource_id']} asks for {x['type'].replace('_', ' ')} of {what}"

        basis = set(r["verdict"]["basis_finding_ids"])
        items = {e["id"]: e for e in r["evidence"]["items"]}
        why = []
        for f in r["findings"]:
            if f["id"] in basis:
                why += [f"{f['kind'].replace('_', ' ')}: " + "; ".join(map(said, f["requirement_ids"]))]
                why += [f"  by {items[e]['method'].replace('_', ' ')} ({items[e]['strength'].replace('_', ' ')})" for e in f["evidence_ids"] if e in items]
        part("Why", why)
        part("Smallest sets that clash", [f"{c['kind']}: " + "; ".join(map(said, c["requirement_ids"])) for c in r["conflict_cores"]])
        part("It holds as long as", [c["kind"].replace("_", " ") for c in r["conditions"]])
        tally = {s: len(r["verdict"]["constraint_states"][s]) for s in STATES}
        part("What must hold", [f"{n} {s.replace('_', ' ')}" for s, n in tally.items() if n])
        methods: dict[tuple[str, str], int] = {}
        for e in items.values():
            methods[e["method"], e["polarity"]] = methods.get((e["method"], e["polarity"]), 0) + 1
        part("Evidence", [f"{n} times {m.replace('_', ' ')} {p}" for (m, p), n in sorted(methods.items())])
        part("Names taken for others", [f"{b['local_sequence_name']} of {b['resource_id']} is {b['anchor_sequence_name']} ({b['method'].replace('_', ' ')})" for b in r["sequence_bindings"] if b["local_sequence_name"] != b["anchor_sequence_name"]])
        part("Dictionaries of alignments", [f"{a['resource_id']}: members {a['membership']}, names {a['naming']}, order {a['order']}, content {a['content']}" for a in r["alignment_relationships"]])
        for p in r["profile_contexts"]:
            part(f"Profile {p['profile_id']} for {p['target']}", [f"source {s['id']}: {s['locator']}, {s['acquired_at']}" for s in p["sources"]] + [f"{t['local_name']} of {t['resource_id']}: {t['outcome'].replace('_', ' ')}, {t['reason'].replace('_', ' ')}" for t in p["sequence_traces"]])
        part("Also seen", [f"{o['resource_id']}: {o['kind'].replace('_', ' ')} {o['value']}" + (f" ({o['path']}:{o['line_number']})" if o.get("line_number") else "") for o in r["observations"]])
    part("Files", [f"{x.id}: {x.display_name or (PurePath(x.path).name if x.path else x.id)}, {x.kind}" + (", the anchor" if x.id == q.anchor else "") + ("" if x.id in q.scoped else ", not judged") for x in kinds.values()])
    part("Sequences judged", list(q.anchor_names or ()))
    part("Profiles", list(q.profiles))
    lines.append(f"Report {SCHEMA_VERSION}, engine {TOOL_VERSION}" + (f", policy {q.policy}" if q.policy else ""))
    return "\n".join(lines) + "\n"


def exit_code(report: Report) -> int:
    if report.status == "invalid_input":
        return EXIT["invalid_input"]
    if report.verdict == "incompatible":
        return EXIT["incompatible"]
    if report.status == "partial":
        return EXIT["partial"]
    return EXIT["indeterminate"] if report.verdict == "indeterminate" else EXIT["success"]


def broken_references(tables: dict[str, DataFrame], requirements: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Ids that are cited and don't exist, as ``edge, id``; empty for a sound bundle."""
    judged, evidence, findings, cores = (tables[k] for k in ("constraints", "evidence", "findings", "cores"))

    def edge(name: str, rows: DataFrame, column: str, target: DataFrame, key: str, many: bool = False) -> DataFrame:
        cited = rows.select((F.explode(column) if many else F.col(column)).alias("id")).distinct()
        return cited.join(target.select(F.col(key).alias("id")), "id", "left_anti").select(F.lit(name).alias("edge"), "id")

    found = edge("constraint-requirement", judged, "requirement_id", requirements, "requirement_id")
    for e in (
        edge("constraint-candidate", judged, "candidate_ids", capabilities, "capability_id", True),
        edge("constraint-cited", judged, "cited_ids", capabilities, "capability_id", True),
        edge("evidence-constraint", evidence, "constraint_id", judged, "constraint_id"),
        edge("evidence-capability", evidence, "capability_id", capabilities, "capability_id"),
        edge("finding-constraint", findings, "constraint_id", judged, "constraint_id"),
        edge("finding-evidence", findings, "evidence_ids", evidence, "evidence_id", True),
        edge("core-finding", cores, "finding_id", findings, "finding_id"),
    ):
        found = found.unionByName(e)
    return found
