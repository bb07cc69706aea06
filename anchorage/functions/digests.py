"""Digests and normal forms as column expressions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes outside A, C, G, T, N and the base each is reduced to in variant files.
IUPAC_FROM, IUPAC_TO = "BDHKMRSVWY", "CAAGAACAAC"
_REDUCIBLE = "^[ABCDGHKMNRSTVWY]*$"


def normalized(sequence: Column) -> Column:
    """ASCII letters only, in upper case.  Filtering comes first, as upper case of other letters differs by engine."""
    return F.upper(F.regexp_replace(sequence, "[^A-Za-z]", ""))


def sequence_md5(sequence: Column) -> Column:
    return F.md5(normalized(sequence).cast("binary"))


def sha512t24u(value: Column) -> Column:
    """The first 24 bytes of SHA-512 in URL-safe Base64."""
    return F.translate(F.base64(F.substring(F.unhex(F.sha2(value.cast("binary"), 512)), 1, 24)), "+/", "-_")


def refget_id(sequence: Column) -> Column:
    return F.concat(F.lit("SQ."), sha512t24u(normalized(sequence)))


def json_strings(values: Column) -> Column:
    """A compact JSON array of plain ASCII strings."""
    return F.concat(F.lit('["'), F.array_join(values, '","'), F.lit('"]'))


def collection_digests(names: Column, lengths: Column, refget_ids: Column) -> Column:
    """Digests of a collection's ordered arrays; the top one covers names and sequences."""
    name_digest = sha512t24u(json_strings(names))
    length_digest = sha512t24u(F.concat(F.lit("["), F.array_join(lengths.cast("array<string>"), ","), F.lit("]")))
    sequence_digest = sha512t24u(json_strings(refget_ids))
    top = sha512t24u(F.concat(F.lit('{"names":"'), name_digest, F.lit('","sequences":"'), sequence_digest, F.lit('"}')))
    return F.struct(top.alias("collection"), name_digest.alias("names"), length_digest.alias("lengths"), sequence_digest.alias("sequences"))


def ascii_upper(text: Column) -> Column:
    """Upper case of a to z alone, which is the same in every engine and keeps lengths."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def reducible(bases: Column) -> Column:
    """Whether every base has a place in variant files."""
    return ascii_upper(bases).rlike(_REDUCIBLE)


def reduced(bases: Column) -> Column:
    """Upper case, ambiguity codes as the base a variant file shows for them."""
    return F.translate(ascii_upper(bases), IUPAC_FROM, IUPAC_TO)


def valid_md5(value: Column) -> Column:
    """A declared MD5 in lower case, null if it isn't one."""
    return F.when(value.rlike("^[0-9a-fA-F]{32}$"), F.lower(value))


def is_gzip(content: Column) -> Column:
    """Decided by the first two bytes, never by the name."""
    return F.coalesce(F.hex(F.substring(content, 1, 2)) == "1F8B", F.lit(False))


def attribute(attributes: Column, key: str) -> Column:
    """All values of a ``key=value`` attribute in a semicolon list."""
    fields = F.transform(F.split(attributes, ";"), lambda x: F.trim(x))
    return F.transform(F.filter(fields, lambda x: x.startswith(key + "=")), lambda x: F.substring(x, len(key) + 2, 1 << 30))


def stable_id(prefix: str, parts: Sequence) -> str:
    """``prefix:`` and the SHA-256 of the parts as compact ASCII JSON."""
    text = json.dumps(list(parts), ensure_ascii=True, separators=(",", ":"))
    return f"{prefix}:{hashlib.sha256(text.encode()).hexdigest()}"


def stable_id_column(prefix: str, *parts: Column) -> Column:
    """:func:`stable_id` of flat ASCII strings as an expression."""
    quoted = [F.concat(F.lit('"'), F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')) for p in parts]
    return F.concat(F.lit(prefix + ":"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]")), 256))
