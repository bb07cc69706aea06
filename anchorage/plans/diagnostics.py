"""Diagnostics of single files: FASTA identity, index against FASTA, dictionary against FASTA."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from anchorage.errors import InputError
from anchorage.operators import collections
from anchorage.sources import fasta, headers
from anchorage.sources.identity import FromBases, IdentityProvider
from anchorage.staging import written

TIER = "tier_b_direct_structural"
_KINDS = ("record_count", "missing_sequence", "extra_sequence", "order", "length", "offset", "line_bases", "line_bytes", "m5_conflict")


def _sorted(df: DataFrame, order: dict[str, int]) -> list[dict]:
    rows = [r.asDict() for r in df.collect()]
    return sorted(rows, key=lambda r: (_KINDS.index(r["kind"]), order.get(r["name"] or "", 1 << 62), r["name"] or ""))


def fasta_identity(spark: SparkSession, path: str, provider: IdentityProvider | None = None) -> dict:
    rows = written((provider or FromBases()).identities(spark, path), "identities")
    top = fasta.collection(rows).first()
    return {
        "type": "sequence_collection_snapshot", "resource_id": path, "completeness": top["completeness"], "collection_digest": top["collection"],
        "attribute_digests": {k: top[k] for k in ("names", "lengths", "sequences")},
        "sequences": [{"ordinal": r["ordinal"], "local_name": r["name"], "length": r["length"], "refget_id": r["refget"], "md5": r["md5"]} for r in rows.orderBy("ordinal").collect()],
    }


def index_integrity(spark: SparkSession, path: str, index: str) -> dict:
    expected, observed = fasta.expected_index(spark, path), fasta.read_index(spark, index)
    order = {r["name"]: r["ordinal"] for r in expected.select("name", "ordinal").collect()}
    found = _sorted(collections.index_differences(expected, observed), order)
    return {"type": "fasta_index_integrity", "fasta_resource_id": path, "index_resource_id": index, "verified": not found, "evidence_strength": TIER, "evidence_polarity": "contradicts" if found else "supports", "differences": found}


def dictionary_integrity(spark: SparkSession, path: str, dictionary: str, provider: IdentityProvider | None = None) -> dict:
    expected = fasta.expected_dictionary(written((provider or FromBases()).identities(spark, path), "identities"))
    observed = headers.read_dictionary(spark, dictionary)
    order = {r["name"]: r["ordinal"] for r in expected.select("name", "ordinal").collect()}
    found = _sorted(collections.dictionary_differences(expected, observed), order)
    gaps = [r["name"] for r in collections.dictionary_gaps(expected, observed).orderBy("name").collect()]
    pairs = [r.asDict() for r in collections.cross_name_pairs(expected, observed).orderBy("expected_name").collect()]
    structure = all(d["kind"] == "m5_conflict" for d in found)
    content = not gaps and not found
    return {
        "type": "sequence_dictionary_integrity", "fasta_resource_id": path, "dictionary_resource_id": dictionary, "structurally_verified": structure, "content_verified": content, "exact_companion_verified": structure and content,
        "has_conflict": bool(found) or any(p["state"] != "match" for p in pairs), "differences": found, "missing_m5_sequences": gaps,
        "renamed_identity_matches": [{k: p[k] for k in ("expected_name", "observed_name", "md5")} for p in pairs if p["state"] == "match"],
        "cross_name_m5_length_inconsistencies": [{k: p[k] for k in ("expected_name", "observed_name", "md5")} for p in pairs if p["state"] != "match"],
    }


def text(found: dict) -> str:
    """Label and value a line; lists indented."""
    lines = []
    for key, value in found.items():
        label = key.replace("_", " ")
        if isinstance(value, list):
            lines.append(f"{label}:")
            lines += [f"- {', '.join(f'{k}={v}' for k, v in x.items()) if isinstance(x, dict) else x}" for x in value] or ["- none"]
        elif isinstance(value, dict):
            lines += [f"{label} {k}: {v}" for k, v in value.items()]
        else:
            lines.append(f"{label}: {('yes' if value else 'no') if isinstance(value, bool) else 'unavailable' if value is None else value}")
    return "\n".join(lines) + "\n"


COMMANDS: dict[str, tuple[Callable[..., dict], tuple[str, ...]]] = {"inspect-fasta": (fasta_identity, ("fasta",)), "check-fai": (index_integrity, ("fasta", "fai")), "check-dict": (dictionary_integrity, ("fasta", "dict"))}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Differences alone still end with 0; input that can't be read ends with 2."""
    parser = argparse.ArgumentParser(prog="anchorage")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, files) in COMMANDS.items():
        sub = commands.add_parser(name)
        for f in files:
            sub.add_argument(f)
        sub.add_argument("--format", choices=("human", "json"), default="human")
    args = parser.parse_args(argv)
    run, files = COMMANDS[args.command]
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        found = run(spark, *(getattr(args, f) for f in files))
    except InputError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    sys.stdout.write(json.dumps(found, indent=2, ensure_ascii=False) + "\n" if args.format == "json" else text(found))
    return 0
