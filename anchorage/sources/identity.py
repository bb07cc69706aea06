"""Where the identities of a FASTA file's sequences come from, and single stretches of its bases."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from anchorage.errors import FetchError
from anchorage.sources import fasta
from anchorage.sources.lines import opened


class IdentityProvider(Protocol):
    """Anything that tells ``ordinal, name, length, md5, refget`` of the sequences of a file."""

    def identities(self, spark: SparkSession, path: str) -> DataFrame: ...


class FromBases:
    """The provider used unless another is given: digests of the bases themselves."""

    def identities(self, spark: SparkSession, path: str) -> DataFrame:
        return fasta.file_identities(spark, path)


class BaseReader:
    """Single stretches of bases from a plain FASTA file, on the driver.

    The places of sequences are computed from the file; an index beside it is
    never trusted.  A fetch seeks and reads its own lines and nothing else.
    For many stretches join them to chunks instead.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        rows = fasta.expected_index(spark, path).collect()  # one row a sequence
        self._places = {r["name"]: r for r in rows}

    def length(self, name: str) -> int:
        return self._place(name)["length"]

    def _place(self, name: str):
        if name not in self._places:
            raise FetchError(f"no sequence {name!r}", self._path)
        return self._places[name]

    def fetch(self, name: str, start: int, end: int) -> str:
        """Zero-based half-open."""
        r = self._place(name)
        if not 0 <= start <= end <= r["length"]:
            raise FetchError(f"{start} to {end} is not within {name!r}", self._path)
        if start == end:
            return ""

        def at(base: int) -> int:
            return r["offset"] + base // r["line_bases"] * r["line_bytes"] + base % r["line_bases"]

        first, last = at(start), at(end - 1) + 1
        with opened(self._spark, self._path, start=first) as file:
            data = file.read(last - first)
        bases = data.translate(None, b"\r\n").decode("utf-8")
        if len(bases) != end - start:
            raise FetchError(f"{name!r} ends before {end}", self._path)
        return bases
