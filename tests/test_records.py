import gzip
import struct

import pytest

from anchorage.errors import ParseError, UnsupportedResource
from anchorage.operators import bounds, refbases, resolve
from anchorage.sources import annotation, bed, headers, variants
from anchorage.sources.lines import lines_of, numbered_lines, with_ordinal
from anchorage.streaming import arrivals

VCF = "##fileformat=VCFv4.3\n##reference=file:///ref.fa\n##contig=<ID=chr1,length=8,md5=ABC>\n##contig=<ID=chr1,length=9>\n##contig=<ID=chr2,length=x>\n#CHROM\tPOS\tID\tREF\tALT\n" + "".join(
    f"{c}\t{p}\t.\t{r}\tA\n" for c, p, r in (("chr1", 1, "A"), ("chr1", 4, "TA"), ("chr1", 3, "T"), ("chr1", 9, "A"), ("chrUn", 1, "A"), ("chr2", 1, "T"))
)


@pytest.fixture
def anchor(spark):
    return spark.createDataFrame([("chr1", "ACGTACGT", 0, 8), ("chr2", "TTTT", 1, 4)], "name string, sequence string, ordinal long, length long")


def test_variants_against_bases(spark, tmp_path, anchor):
    path = tmp_path / "calls.vcf"
    path.write_text(VCF)
    facts = variants.header(spark, str(path))
    assert facts["reference_claims"] == ["file:///ref.fa"]
    assert [(r["name"], r["length"]) for r in facts["contigs"].orderBy("ordinal").collect()] == [("chr1", 8), ("chr2", None)]
    checked = refbases.check(variants.records(spark, str(path)), anchor)
    assert [r["state"] for r in checked.orderBy("ordinal").collect()] == ["match", "match", "mismatch", "out_of_bounds", "unresolved_sequence", "match"]
    total = refbases.capability(refbases.outcomes(checked, None)).first()
    assert (total["checked"], total["conflict"], total["unresolved"]) == (6, 1, 2)
    assert refbases.conflict_pattern(refbases.outcomes(checked)).first()["pattern"] == "unclassified"
    assert [r["found"] for r in refbases.problems(checked).where("state = 'mismatch'").collect()] == ["G"]


def test_ambiguity_codes_case_and_telomere(spark, anchor):
    bases = spark.createDataFrame([("s", "acRYN")], "name string, sequence string")
    rows = spark.createDataFrame([("s", 1, "AC"), ("s", 3, "A"), ("s", 4, "C"), ("s", 4, "T"), ("s", 5, "N"), ("s", 0, "N")], "sequence_name string, position long, ref string")
    assert [r["state"] for r in refbases.check(rows, bases).collect()] == ["match", "match", "match", "mismatch", "match", "out_of_bounds"]


def test_bindings_rename(spark, anchor):
    rows = spark.createDataFrame([("1", 1, "A"), ("2", 1, "A")], "sequence_name string, position long, ref string")
    bound = spark.createDataFrame([("1", "chr1")], "local_name string, anchor_name string")
    assert {r["sequence_name"]: r["state"] for r in refbases.check(rows, anchor, bound).collect()} == {"1": "match", "2": "unresolved_sequence"}


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 100])
def test_chunks_change_nothing(spark, anchor, chunk):
    rows = [(i, c, p, r) for i, (c, p, r) in enumerate((c, p, r) for c in ("chr1", "chr2", "no") for p in range(0, 11) for r in ("A", "ACG", "TTTT", "GTACG"))]
    records = spark.createDataFrame(rows, "ordinal long, sequence_name string, position long, ref string")
    whole = {r["ordinal"]: (r["state"], r["found"]) for r in refbases.check(records, anchor).collect()}
    parts = {r["ordinal"]: (r["state"], r["found"]) for r in refbases.check_chunked(records, refbases.chunked(anchor, chunk), chunk).collect()}
    assert whole == parts and len(parts) == len(rows)


@pytest.mark.parametrize(("counts", "pattern"), [([(5, 0, 0, 0)], "none"), ([(5, 1, 0, 0)], "isolated"), ([(0, 2, 0, 0), (0, 3, 0, 0)], "systematic"), ([(1, 2, 0, 0), (0, 3, 0, 0)], "distributed"), ([(1, 2, 0, 0), (4, 0, 0, 0)], "localized"), ([(1, 2, 1, 0)], "unclassified")])
def test_patterns(spark, counts, pattern):
    rows = spark.createDataFrame([(f"s{i}", *c) for i, c in enumerate(counts)], "sequence_name string, match long, mismatch long, out_of_bounds long, unresolved_sequence long")
    assert refbases.conflict_pattern(rows).first()["pattern"] == pattern


def _bcf(records, names=("chr1", "chr2")):
    text = "##fileformat=VCFv4.3\n" + "".join(f"##contig=<ID={n}>\n" for n in names) + "#CHROM\n\0"
    data = b"BCF\2\2" + struct.pack("<I", len(text)) + text.encode()
    for contig, position, ref in records:
        shared = struct.pack("<iiifII", contig, position - 1, len(ref), 0.0, 2 << 16, 0) + b"\x17." + bytes([len(ref) << 4 | 7]) + ref.encode() + b"\x17A"
        data += struct.pack("<II", len(shared), 0) + shared
    return gzip.compress(data)


def test_binary_variants_read_like_text(spark, tmp_path):
    path = tmp_path / "calls.bcf"
    path.write_bytes(_bcf([(0, 1, "A"), (1, 4, "TAG")]))
    assert [tuple(r) for r in variants.records(spark, str(path), "bcf").orderBy("ordinal").collect()] == [(0, "chr1", 1, "A"), (1, "chr2", 4, "TAG")]
    assert [r["name"] for r in variants.header(spark, str(path), "bcf")["contigs"].collect()] == ["chr1", "chr2"]
    with pytest.raises(UnsupportedResource):
        variants.header(spark, str(path), "vcf")


def test_binary_variants_over_splits(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = [(r.randint(0, 1), r.randint(1, 10**6), "".join(r.choice("ACGTN") for _ in range(r.randint(1, 14)))) for _ in range(6000)]
    path = tmp_path / "many.bcf"
    path.write_bytes(_bcf(rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [tuple(x) for x in variants.records(spark, str(path), "bcf").orderBy("ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(k, f"chr{c + 1}", p, ref) for k, (c, p, ref) in enumerate(rows)]
    (tmp_path / "cut.bcf").write_bytes(path.read_bytes()[:-4000])
    with pytest.raises(Exception, match="breaks off"):
        variants.records(spark, str(tmp_path / "cut.bcf"), "bcf").count()


@pytest.mark.parametrize("line", ["chr1\tx\t.\tA\tC", "chr1\t1\t.\tAX\tC", "chr1\t1\t.\tA", "\t1\t.\tA\tC"])
def test_broken_records(spark, line):
    assert variants.parse_records(lines_of(spark, line)).first()["error"] is not None


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "long.txt"
    path.write_text("".join(f"line {i}\n" for i in range(1, 40_001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        assert numbered_lines(spark, str(path)).where("value <> concat('line ', line_number)").count() == 0
        assert with_ordinal(numbered_lines(spark, str(path)).where("line_number % 2 = 0")).where("ordinal <> line_number / 2 - 1").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


BED12 = "chr1\t10\t30\tn\t0\t+\t10\t30\t0\t2\t5,6,\t0,14\n"


@pytest.mark.parametrize(
    ("layout", "text", "message"),
    [
        ("bed3", "chr1\t1\t2\n# c\n\nchr1 3 3\n", None), ("bed3", "chr1.1\t1\t2\n", "chrom"), ("bed3", "chr1\t-1\t2\n", "chromStart"), ("bed3", "chr1\t1\t18446744073709551615\n", None), ("bed3", "chr1\t1\t18446744073709551616\n", "chromEnd"),
        ("bed3", "chr1\t3\t2\n", "exceeds"), ("bed3", "track name=x\n", "track"), ("bed3", "chr1\t1\n", "fields"), ("bed3", " chr1 1 2\n", "blanks"), ("bed3", "chré\t1\t2\n", "ASCII"), ("bed5", "c\t1\t2\tn\t1001\n", "1000"),
        ("bed6", "c\t1\t2\tn\t1\tx\n", "strand"), ("bed7", "c\t1\t2\tn\t1\t+\t3\n", "thickStart"), ("bed8", "c\t1\t5\tn\t1\t+\t3\t2\n", "thickEnd"), ("bed9", "c\t1\t5\tn\t1\t+\t3\t4\t1,2,256\n", "itemRgb"), ("bed9", "c\t1\t5\tn\t1\t+\t3\t4\t1,2,255\n", None),
        ("bed12", BED12, None), ("bed12", BED12.replace("0,14", "1,14"), "start at 0"), ("bed12", BED12.replace("5,6,", "15,6"), "overlap"), ("bed12", BED12.replace("0,14", "0,13"), "end with"), ("bed12", BED12.replace("\t2\t5", "\t3\t5"), "differ in length"), ("bed12", BED12.replace("5,6,", "5;6"), "blockSizes"),
    ],
)
def test_interval_rules(spark, layout, text, message):
    errors = [r["error"] for r in bed.parse(lines_of(spark, text), layout).collect()]
    assert (errors[0] is None) if message is None else message in errors[0]


def test_intervals_of_a_file(spark, tmp_path):
    path = tmp_path / "x.bed"
    path.write_bytes(gzip.compress(b"chr1\t0\t4\r\nchr1\t8\t8\r\nchr2\t1\t9\n"))
    rows = bed.read(spark, str(path), "bed3")
    anchor = spark.createDataFrame([("chr1", 8), ("chr3", 9)], "name string, length long")
    assert [(r["ordinal"], r["state"]) for r in bounds.check_intervals(rows, anchor).orderBy("ordinal").collect()] == [(0, "representable"), (1, "representable"), (2, "unresolved_sequence")]
    use = {r["sequence_name"]: (r["n_records"], r["n_empty"]) for r in bounds.interval_usage(rows).collect()}
    assert use == {"chr1": (2, 1), "chr2": (1, 0)}
    (tmp_path / "bad.bed").write_text("chr1\t0\t4\nchr1\t9\t8\nchr 1\n")
    with pytest.raises(ParseError) as found:
        bed.read(spark, str(tmp_path / "bad.bed"), "bed3")
    assert found.value.line == 2
    with pytest.raises(UnsupportedResource):
        bed.parse(lines_of(spark, ""), "bed10")


GFF = "##gff-version 3.1.26\n##sequence-region chrM 1 100\n##species human\n#!genome-build X1\nchrM\tx\tregion\t1\t100\t.\t.\t.\tIs_circular=true;ID=m\nchrM\tx\tgene\t90\t120\t.\t.\t.\tID=a\nchr%20A\tx\tgene\t1\t2\t.\t.\t.\t.\n##FASTA\n>chrM x\nAC gt\n>e\nTTTT\n"


def test_annotation_file(spark, tmp_path):
    path = tmp_path / "x.gff3"
    path.write_text(GFF)
    lines = numbered_lines(spark, str(path))
    rows = annotation.features(spark, str(path), "gff3")
    assert [(r["ordinal"], r["sequence_name"], r["is_circular"]) for r in rows.orderBy("ordinal").collect()] == [(0, "chrM", True), (1, "chrM", False), (2, "chr A", False)]
    assert [(r["name"], r["value"]) for r in annotation.claims(lines, "gff3").orderBy("line_number").collect()] == [("##species", "human"), ("#!genome-build", "X1")]
    assert {r["sequence_name"]: (r["length"], r["error"]) for r in annotation.embedded(lines).collect()} == {"chrM": (4, None), "e": (4, None)}
    assert annotation.parse_regions(lines).first()["end"] == 100 and annotation.versions(lines).first()["error"] is None
    anchor = spark.createDataFrame([("chrM", 100)], "name string, length long")
    got = [r["state"] for r in bounds.check_features(rows, anchor).orderBy("ordinal").collect()]
    assert got == ["representable", "circular_representable", "unresolved_sequence"]
    assert bounds.feature_errors(bounds.check_features(rows, anchor), annotation.parse_regions(lines)).count() == 0


@pytest.mark.parametrize(
    ("kind", "line", "message"),
    [
        ("gtf", "c\tx\tgene\t1\t2\t.\t.\t.", "nine"), ("gtf", "c\tx\tgene\t0\t2\t.\t.\t.\t.", "start"), ("gtf", "c\tx\tgene\t3\t2\t.\t.\t.\t.", "exceeds"), ("gtf", "\tx\tgene\t1\t2\t.\t.\t.\t.", "sequence id"), ("gtf", "c\tx\t\t1\t2\t.\t.\t.\t.", "type"),
        ("gff3", "c%41\tx\tgene\t1\t2\t.\t.\t.\t.", "sequence id"), ("gff3", "c%ff\tx\tgene\t1\t2\t.\t.\t.\t.", "sequence id"), ("gff3", "c d\tx\tgene\t1\t2\t.\t.\t.\t.", "sequence id"), ("gff3", "c\tx\tgene\t1\t2\t.\t.\t.\tIs_circular=false", "true"),
        ("gff3", "c\tx\tgene\t1\t2\t.\t.\t.\tIs_circular=true;Is_circular=true", "twice"), ("gff3", "c\tx\tgene\t1\t2\t.\t.\t.\tIs_circular=true;ID=", "empty"), ("gtf", "c\tx\tgene\t1\t99999999999999999999999999\t.\t.\t.\t.", None),
    ],
)
def test_annotation_rules(spark, kind, line, message):
    error = annotation.parse_features(lines_of(spark, line), kind).first()["error"]
    assert error is None if message is None else message in error


def test_circular_rules(spark):
    rows = [("a", 90, 120, 100, True), ("a", 101, 120, 100, True), ("a", 90, 190, 100, True), ("a", 90, 120, 100, False), ("a", 90, 99, 100, True), ("a", 20, 130, 100, True)]
    df = spark.createDataFrame(rows, "s string, a long, e long, l long, ok boolean")
    from pyspark.sql import functions as F

    got = [r[0] for r in df.select(bounds.wrap_state(F.col("a"), F.col("e"), F.col("l"), F.col("ok"))).collect()]
    assert got == ["representable", "invalid", "invalid", "unresolved", "none", "invalid"]


def test_alignment_headers(spark, tmp_path):
    text = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:chr1\tLN:8\n@PG\tID:x\tPN:tool\n@CO\tfree\n"
    refs = b"\5\0\0\0chr1\0" + struct.pack("<i", 8)
    body = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", 1) + refs
    path = tmp_path / "a.bam"
    path.write_bytes(gzip.compress(body))
    found = headers.read_alignment_header(spark, str(path), "bam")
    assert (found.sort_order, found.sequences[0][:2], found.programs[0][:2]) == ("coordinate", ("chr1", 8), ("x", "tool"))
    path.write_bytes(gzip.compress(b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + refs))
    assert headers.read_alignment_header(spark, str(path), "bam").dictionary(spark).first()["name"] == "chr1"
    path.write_bytes(gzip.compress(body.replace(b"LN:8", b"LN:9")))
    with pytest.raises(ParseError):
        headers.read_alignment_header(spark, str(path), "bam")
    with pytest.raises(UnsupportedResource):
        headers.read_alignment_header(spark, str(path), "cram")


def test_arriving_files(spark, tmp_path, anchor):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.vcf").write_text(VCF)
    (folder / "b.vcf").write_text("chr2\t9\t.\tA\tC\nchr2\tx\t.\tA\tC\n")
    out = str(tmp_path / "out")
    arrivals.write_outcomes(arrivals.check_arrivals(spark, str(folder), anchor), out, str(tmp_path / "state")).awaitTermination()
    counts = {r["state"]: r["count"] for r in spark.read.parquet(out).groupBy("state").count().collect()}
    assert counts == {"match": 3, "mismatch": 1, "out_of_bounds": 2, "unresolved_sequence": 1, "invalid": 1}


def test_unknown_scope_names(spark, anchor):
    picked = spark.createDataFrame([("chr1",), ("chr9",)], "name string")
    assert [r["name"] for r in resolve.unknown_scope_names(anchor, picked).collect()] == ["chr9"]


def test_contexts_of_whole_files(spark, tmp_path):
    (tmp_path / "c.vcf").write_text(VCF)
    found = variants.context(spark, str(tmp_path / "c.vcf"))
    assert {(r["sequence_name"], r["n_records"], r["first_ordinal"]) for r in found["usage"].collect()} == {("chr1", 4, 0), ("chrUn", 1, 4), ("chr2", 1, 5)} and found["file_format"] == "VCFv4.3"
    (tmp_path / "c.bed").write_text("chr1\t1\t5\nchr1\t3\t3\n")
    row = bed.context(spark, str(tmp_path / "c.bed"), "bed3").first()
    assert (row["sequence_name"], row["n_records"], row["n_empty"], row["layout"]) == ("chr1", 2, 1, "bed3")
    (tmp_path / "c.gff3").write_text("##gff-version 3\n##sequence-region chr1 1 9\n#!genome-build B\nchr1\tx\tgene\t1\t5\t.\t.\t.\tID=a\n##FASTA\n>chr1\nACGTACGTA\n")
    found = annotation.context(spark, str(tmp_path / "c.gff3"), "gff3")
    assert found["usage"].first()["n_records"] == 1 and found["regions"].first()["end"] == 9 and found["embedded"].first()["length"] == 9 and found["claims"].first()["value"] == "B" and found["versions"].first()["version"] == "3"
