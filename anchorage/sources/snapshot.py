"""Provider snapshots: a strict JSON file of a genome browser's sequence catalog, aliases and identities."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from datetime import UTC, datetime
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession

from anchorage.errors import ParseError, Unreadable

# The dimensions, states and keys of the file format.
DIMENSIONS = ("sequence_catalog", "aliases", "content_identity")
COMPLETENESS = ("complete", "partial", "unknown")
SCHEMA = "anchorage.provider-snapshot.v1"
_REFGET = re.compile(r"SQ\.[A-Za-z0-9_-]{32}")
_MD5 = re.compile(r"[0-9a-f]{32}")
_KEYS = {
    "top": {"schema", "database_id", "context_id", "completeness", "sources", "sequences", "aliases"},
    "sources": {"id", "database_id", "context_id", "locator", "acquired_at", "dimensions"},
    "sequences": {"canonical_name", "length", "catalog_source_ids", "refget_id", "md5", "identity_source_ids"},
    "aliases": {"alias", "canonical_name", "source_ids", "authority"},
}


@dataclass(frozen=True)
class Snapshot:
    database: str
    context: str
    completeness: dict[str, str]
    sources: DataFrame
    sequences: DataFrame
    aliases: DataFrame
    digest: str


def _once(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key appears twice")
    return found


def parse(data: bytes, path: str = "<memory>", expected_sha256: str | None = None) -> dict:
    """The checked document.  Keys must be exactly those of the schema, each once."""
    digest = hashlib.sha256(data).hexdigest()
    if expected_sha256 is not None and digest != expected_sha256.lower():
        raise ParseError("the file's digest is not the expected one", path)

    def need(good: bool, message: str) -> None:
        if not good:
            raise ParseError(message, path)

    try:
        doc = json.loads(data.decode("utf-8"), object_pairs_hook=_once)
    except ValueError as error:
        raise ParseError(f"not a strict JSON document: {error}", path) from error
    need(isinstance(doc, dict) and set(doc) == _KEYS["top"], "unexpected or missing keys")
    need(isinstance(doc["schema"], str) and doc["schema"].endswith("provider-snapshot.v1"), "unknown schema")
    need(isinstance(doc["completeness"], dict) and set(doc["completeness"]) == set(DIMENSIONS) and set(doc["completeness"].values()) <= set(COMPLETENESS), "completeness needs three dimensions")
    for part in ("sources", "sequences", "aliases"):
        need(isinstance(doc[part], list) and all(isinstance(r, dict) and set(r) == _KEYS[part] for r in doc[part]), f"unexpected or missing keys in {part}")
    by_dimension: dict[str, set] = {d: set() for d in DIMENSIONS}
    ids = set()
    for s in doc["sources"]:
        need(s["id"] not in ids, "source ids are not distinct")
        ids.add(s["id"])
        need((s["database_id"], s["context_id"]) == (doc["database_id"], doc["context_id"]), "a source belongs to another database or context")
        try:
            when = datetime.fromisoformat(s["acquired_at"])
        except ValueError as error:
            raise ParseError("acquired_at is no timestamp", path) from error
        need(when.tzinfo is not None, "acquired_at has no time zone")
        s["acquired_at"] = when.astimezone(UTC)
        need(bool(s["dimensions"]) and set(s["dimensions"]) <= set(DIMENSIONS), "unknown dimension")
        for d in s["dimensions"]:
            by_dimension[d].add(s["id"])
    names = [s["canonical_name"] for s in doc["sequences"]]
    need(len(set(names)) == len(names), "canonical names are not distinct")
    for s in doc["sequences"]:
        need(isinstance(s["length"], int) and s["length"] >= 0, "a length is a non-negative integer")
        need(bool(s["catalog_source_ids"]) and set(s["catalog_source_ids"]) <= by_dimension["sequence_catalog"], "a sequence cites no catalog source")
        need(s["refget_id"] is None or bool(_REFGET.fullmatch(s["refget_id"])), "a refget id is malformed")
        need(s["md5"] is None or bool(_MD5.fullmatch(s["md5"])), "an MD5 is malformed")
        has = s["refget_id"] is not None or s["md5"] is not None
        need(set(s["identity_source_ids"]) <= by_dimension["content_identity"] and has == bool(s["identity_source_ids"]), "an identity cites no identity source")
    for a in doc["aliases"]:
        need(a["canonical_name"] in names, "an alias has an unknown target")
        need(bool(a["source_ids"]) and set(a["source_ids"]) <= by_dimension["aliases"], "an alias cites no alias source")
    return doc | {"digest": digest}


def load(spark: SparkSession, path: str, expected_sha256: str | None = None) -> Snapshot:
    rows = spark.read.format("binaryFile").load(path).select("content").head(1)
    if not rows:
        raise Unreadable("cannot read file", path)
    doc = parse(bytes(rows[0]["content"]), path, expected_sha256)

    def table(part: str, schema: str) -> DataFrame:
        names = [c.strip().split(" ")[0] for c in schema.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in doc[part]], schema)

    return Snapshot(
        doc["database_id"], doc["context_id"], doc["completeness"], table("sources", "id string, locator string, acquired_at timestamp, dimensions array<string>"),
        table("sequences", "canonical_name string, length long, refget_id string, md5 string, catalog_source_ids array<string>, identity_source_ids array<string>"),
        table("aliases", "alias string, canonical_name string, source_ids array<string>, authority string"), doc["digest"],
    )


def render(doc: dict) -> str:
    """A document in its normal form, the same whatever order its lists came in: sorted keys and lists, UTC times, a final line end."""
    plain = {k: v for k, v in doc.items() if k != "digest"}
    order = {"sources": ("id",), "sequences": ("canonical_name",), "aliases": ("alias", "canonical_name", "authority")}
    for part, keys in order.items():
        rows = [{k: sorted(v) if isinstance(v, list) else v for k, v in r.items()} for r in plain[part]]
        plain[part] = sorted(rows, key=itemgetter(*keys))
    return json.dumps(plain, indent=2, sort_keys=True, ensure_ascii=False, default=lambda t: t.isoformat()) + "\n"
