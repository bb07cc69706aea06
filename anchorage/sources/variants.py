"""VCF and BCF: what the header declares, and CHROM, POS and REF of the records."""

from __future__ import annotations

import gzip
import io
import itertools
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.errors import ParseError, UnsupportedResource
from anchorage.operators.bounds import usage
from anchorage.sources.lines import fail_on_error, first_of, numbered_lines, opened, placed_lines, with_ordinal

CONTIGS = "ordinal long, name string, length long, md5 string, assembly string, url string"
_CONTIG = re.compile(r"##contig=<(.*)>\s*")
_PAIR = re.compile(r'([A-Za-z0-9_.]+)=("(?:[^"\\]|\\.)*"|[^,]*)(?:,|$)')


def header_facts(lines: list[str]) -> dict:
    """File format, reference claims and contigs of header lines.

    Of contigs with one id the first counts; a contig without an id, or with a
    length that is no number, is left out or has no length.
    """
    found: dict = {"file_format": None, "reference_claims": [], "contigs": []}
    seen = set()
    for line in lines:
        if line.startswith("##fileformat="):
            found["file_format"] = line.partition("=")[2].strip()
        elif line.startswith("##reference="):
            found["reference_claims"].append(line.partition("=")[2].strip())
        elif m := _CONTIG.fullmatch(line):
            pairs = {k: v[1:-1] if v.startswith('"') else v for k, v in _PAIR.findall(m[1])}
            name = pairs.get("ID")
            if name and name not in seen:
                seen.add(name)
                length = pairs.get("length", "")
                found["contigs"].append((len(seen) - 1, name, int(length) if length.isascii() and length.isdigit() else None, pairs.get("md5") or pairs.get("M5"), pairs.get("assembly"), pairs.get("URL")))
    return found


def header(spark: SparkSession, path: str, kind: str = "vcf") -> dict:
    """As :func:`header_facts`, with ``contigs`` as a table."""
    if kind == "bcf":
        lines = _bcf_header(spark, path).splitlines()
    elif kind == "vcf":
        _refuse_bcf(spark, path)
        # Only header lines come to the driver.
        lines = [r["value"] for r in numbered_lines(spark, path).where("value like '##%'").orderBy("line_number").collect()]
    else:
        raise UnsupportedResource(f"kind {kind!r} is not vcf or bcf", path)
    facts = header_facts(lines)
    if not facts["file_format"] or not facts["file_format"].startswith("VCFv"):
        raise ParseError("no VCF file format line", path)
    return facts | {"contigs": spark.createDataFrame(facts["contigs"], CONTIGS)}


def _refuse_bcf(spark: SparkSession, path: str) -> None:
    with opened(spark, path) as file:
        if file.peek(2)[:2] == b"\x1f\x8b":
            try:
                if gzip.GzipFile(fileobj=file).read(3) == b"BCF":
                    raise UnsupportedResource("a BCF file was declared as VCF", path)
            except (OSError, EOFError, zlib.error):
                pass


def parse_records(lines: DataFrame) -> DataFrame:
    """``sequence_name, position, ref`` of record lines with an ``error`` column; nothing else is parsed."""
    f = F.split("value", "\t", 5)
    rows = lines.where("value <> '' and not startswith(value, '#')").select("path", "line_number", F.size(f).alias("n"), F.get(f, F.lit(0)).alias("sequence_name"), F.get(f, F.lit(1)).alias("pos"), F.get(f, F.lit(3)).alias("ref"))
    rows = rows.withColumn("position", F.when(F.col("pos").rlike("^[0-9]+$"), F.col("pos")).try_cast("long"))
    error = first_of(
        (F.col("n") < 5, "a record has at least five tab-separated fields"),
        (F.col("sequence_name") == "", "CHROM is empty"),
        (F.col("position").isNull(), "POS is not a non-negative integer"),
        (~F.col("ref").rlike("^[ACGTNacgtn]+$"), "REF must be bases"),
    )
    return rows.withColumn("error", error).select("path", "line_number", "sequence_name", "position", "ref", "error")


def records(spark: SparkSession, path: str, kind: str = "vcf", ordered: bool = True) -> DataFrame:
    """Records in file order.  Without ``ordered`` no ordinal is made and no shuffle is needed."""
    if kind == "bcf":
        return _bcf_records(spark, path)
    _refuse_bcf(spark, path)
    rows = fail_on_error(parse_records(numbered_lines(spark, path)))
    return with_ordinal(rows) if ordered else rows


def _bcf_header(spark: SparkSession, path: str) -> str:
    """The header's text, from the first blocks of the file."""
    with opened(spark, path) as file:
        if file.peek(2)[:2] != b"\x1f\x8b":
            raise UnsupportedResource("not a BCF file", path)
        stream = gzip.GzipFile(fileobj=file)
        try:
            if stream.read(5)[:3] != b"BCF":
                raise UnsupportedResource("not a BCF file", path)
            (size,) = struct.unpack("<I", stream.read(4))
            text = stream.read(size)
            if len(text) < size:
                raise ParseError("the header breaks off", path)
            return text.rstrip(b"\0").decode("utf-8")
        except (OSError, EOFError, struct.error, zlib.error, UnicodeDecodeError) as error:
            raise ParseError("the header breaks off", path) from error


def contig_places(text: str) -> list[str | None]:
    """Contig names by the numbers that records use."""
    names: list[str | None] = []
    seen = set()
    for line in text.splitlines():
        m = _CONTIG.fullmatch(line)
        pairs = {k: v.strip('"') for k, v in _PAIR.findall(m[1])} if m else {}
        if "ID" in pairs and pairs["ID"] not in seen:
            seen.add(pairs["ID"])
            place = int(pairs.get("IDX", len(names)))
            names += [None] * (place + 1 - len(names))
            names[place] = pairs["ID"]
    return names


def bcf_rows(stream, names: list[str | None], path: str) -> Iterator[tuple[int, str, int, str]]:
    """``ordinal, CHROM, POS, REF`` of the records of an unpacked BCF file, read from ``stream`` one by one.

    The record's fixed part gives contig number and zero-based position; then
    come the id and the alleles as typed strings, of which the first is REF.
    """
    data = b""

    def string(at: int) -> tuple[str, int]:
        kind, n = data[at] & 15, data[at] >> 4
        at += 1
        if n == 15:
            width = {1: 1, 2: 2, 3: 4}[data[at] & 15]
            n = int.from_bytes(data[at + 1 : at + 1 + width], "little")
            at += 1 + width
        if kind not in (0, 7):
            raise ParseError("a string is expected", path)
        return data[at : at + n].rstrip(b"\0").decode("ascii"), at + n

    ordinal = 0
    try:
        while head := stream.read(8):
            shared, single = struct.unpack("<II", head)
            data = stream.read(shared)
            if len(data) < shared or len(stream.read(single)) < single:
                raise ParseError("a record breaks off", path)
            contig, position = struct.unpack_from("<ii", data)
            _, place = string(24)
            ref, _ = string(place)
            name = names[contig] if 0 <= contig < len(names) else None
            if name is None:
                raise ParseError("a record names no contig of the header", path)
            if not re.fullmatch("[ACGTNacgtn]+", ref):
                raise ParseError("REF must be bases", path)
            yield ordinal, name, position + 1, ref
            ordinal += 1
    except (OSError, EOFError, zlib.error, struct.error, IndexError, KeyError, UnicodeDecodeError) as error:
        raise ParseError("a record breaks off", path) from error


class _Joined(io.RawIOBase):
    """Pieces of a file one after the other."""

    def __init__(self, pieces: Iterator[bytes]):
        super().__init__()
        self._pieces, self._left = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, room) -> int:
        while not self._left:
            piece = next(self._pieces, None)
            if piece is None:
                return 0
            self._left = memoryview(piece)
        n = min(len(room), len(self._left))
        room[:n], self._left = self._left[:n], self._left[n:]
        return n


def _bcf_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file of any size: its bytes, read in splits as what stands between line feeds, go in order through one task that unpacks and reads them as they come."""
    names = contig_places(_bcf_header(spark, path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (value + b"\n" if count > len(value) else value for batch in batches for count, value in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BufferedReader(_Joined(pieces), 1 << 20)), 1 << 20)
        try:
            head = stream.read(9)
            if not head:
                return
            stream.read(struct.unpack_from("<I", head, 5)[0])
        except (OSError, EOFError, zlib.error, struct.error) as error:
            raise ParseError("the file breaks off", path) from error
        for part in itertools.batched(bcf_rows(stream, names, path), 10_000):
            columns = list(zip(*part, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["ordinal", "sequence_name", "position", "ref"])

    packed = placed_lines(spark, path).select("line_number", "bytes", F.col("value").cast("binary").alias("value"))
    return packed.repartition(1).sortWithinPartitions("line_number").mapInArrow(run, "ordinal long, sequence_name string, position long, ref string")


def context(spark: SparkSession, path: str, kind: str = "vcf") -> dict:
    """What the header declares, and the use of each sequence by the records: ``usage`` with ``sequence_name, n_records, first_ordinal``."""
    return header(spark, path, kind) | {"usage": usage(records(spark, path, kind))}
