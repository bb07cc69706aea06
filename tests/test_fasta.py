import gzip

import pytest

from anchorage.errors import FastaIndexError, ParseError, UnsupportedResource
from anchorage.operators import collections
from anchorage.plans import diagnostics
from anchorage.sources import fasta, headers
from anchorage.sources.lines import lines_of

BASE = ">chrX\nTTGGGGAA\n>chr1\nGGAA\n>chr2\nGCGC\n"


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return write


def test_known_digests(spark, put):
    """Published digests of a small collection."""
    rows = fasta.identities(fasta.bases(spark, put("base.fa", BASE)))
    got = {r["name"]: (r["length"], r["refget"], r["md5"]) for r in rows.collect()}
    assert got == {
        "chrX": (8, "SQ.iYtREV555dUFKg2_agSJW6suquUyPpMw", "5f63cfaa3ef61f88c9635fb9d18ec945"),
        "chr1": (4, "SQ.YBbVX0dLKG1ieEDCiMmkrTZFt_Z5Vdaj", "31fc6ca291a32fb9df82b85e5f077e31"),
        "chr2": (4, "SQ.AcLxtBuKEPk_7PGE_H4dGElwZHCujwH6", "92c6a56c9e9459d8a42b96f7884710bc"),
    }
    top = fasta.collection(rows).first()
    assert (top["collection"], top["names"], top["lengths"], top["sequences"]) == ("XZlrcEGi6mlopZ2uD8ObHkQB1d0oDwKk", "Fw1r9eRxfOZD98KKrhlYQNEdSRHoVxAG", "cGRMZIb3AVgkcAfNv39RN7hnT5Chk7RX", "0uDQVLuHaOZi1u76LjV__yrVUIz9Bwhr")


def test_lower_case_and_line_breaks_do_not_change_identity(spark, put):
    a = fasta.identities(fasta.bases(spark, put("a.fa", ">s x y\nac\ngt\n\n")))
    assert a.first()["md5"] == "f1f8f4bf413b16ad135722aa4591043e"
    packed = fasta.identities(fasta.bases(spark, put("packed.txt", gzip.compress(b">s\r\nAC\r\nGT\r\n"))))
    assert packed.first()["md5"] == "f1f8f4bf413b16ad135722aa4591043e"


@pytest.mark.parametrize("text", [">a\nAC\n>a\nGT\n", "ACGT\n>a\nAC\n", "", ">\nAC\n"])
def test_broken_fasta(spark, put, text):
    with pytest.raises(ParseError):
        fasta.bases(spark, put("x.fa", text))


def test_index_of_a_file_with_two_line_widths(spark, put):
    one, two = "A" * 66, "C" * 28
    text = ">one\n" + "\n".join(one[i : i + 30] for i in range(0, 66, 30)) + "\n>two another chromosome\n" + "\n".join(two[i : i + 14] for i in range(0, 28, 14)) + "\n"
    path = put("example.fa", text)
    got = [tuple(r) for r in fasta.expected_index(spark, path).orderBy("ordinal").select("name", *fasta.GEOMETRY).collect()]
    assert got == [("one", 66, 5, 30, 31), ("two", 28, 98, 14, 15)]
    index = put("example.fa.fai", "one\t66\t5\t30\t31\ntwo\t28\t98\t14\t15\n")
    assert diagnostics.index_integrity(spark, path, index)["verified"]


def test_stale_index(spark, put):
    path, index = put("changed.fa", ">chr1\nACGTA\n>chr2\nTTAA\n"), put("old.fai", "chr1\t4\t6\t4\t5\nchr2\t4\t17\t4\t5\n")
    found = collections.index_differences(fasta.expected_index(spark, path), fasta.read_index(spark, index))
    assert sorted((r["kind"], r["name"], r["expected"], r["observed"]) for r in found.collect()) == [("length", "chr1", "5", "4"), ("line_bases", "chr1", "5", "4"), ("line_bytes", "chr1", "6", "5"), ("offset", "chr2", "18", "17")]


def test_index_refusals(spark, put):
    with pytest.raises(UnsupportedResource):
        fasta.expected_index(spark, put("x.fa", gzip.compress(b">a\nAC\n")))
    for text in (">a\nACG\nA\nAC\n", ">a\n>b\nA\n", ">a\nAC\nACG\n"):
        with pytest.raises(FastaIndexError):
            fasta.expected_index(spark, put("y.fa", text))


@pytest.mark.parametrize(
    ("text", "message"),
    [("a\t4\t6\t4\n", "five"), ("a\t4\t6\t4\tx\n", "integers"), ("a\t4\t6\t5\t6\n", "more bases"), ("a\t4\t6\t4\t3\n", "fewer bytes"), ("a\t4\t6\t2\t2\n", "line ends"), ("a\t-1\t6\t4\t5\n", "negative"), ("a\t4\t6\t4\t5\na\t4\t6\t4\t5\n", "twice"), ("a\t4\t6\t4\t5\n\nb\t4\t6\t4\t5\n", "blank")],
)
def test_index_rules(spark, text, message):
    bad = fasta.parse_index(lines_of(spark, text)).where("error is not null").collect()
    assert len(bad) == 1 and message in bad[0]["error"]


def test_dictionary_order_alias_and_gaps(spark, put):
    path = put("v1.fa", ">chr1\nACGT\n>chr2\nTTAA\n")
    one, two = "M5:f1f8f4bf413b16ad135722aa4591043e", "M5:ecccb7340fe2a704f233bbf07df6c0f3"
    good = put("good.dict", f"@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:4\t{one}\n@SQ\tSN:chr2\tLN:4\t{two}\n")
    assert diagnostics.dictionary_integrity(spark, path, good)["exact_companion_verified"]
    moved = diagnostics.dictionary_integrity(spark, path, put("moved.dict", f"@SQ\tSN:chr2\tLN:4\t{two}\n@SQ\tSN:chr1\tLN:4\t{one}\n"))
    assert [d["kind"] for d in moved["differences"]] == ["order", "order"]
    alias = diagnostics.dictionary_integrity(spark, path, put("alias.dict", f"@SQ\tSN:1\tLN:4\t{one}\tAN:chr1\n@SQ\tSN:2\tLN:5\t{two}\n"))
    assert [m["observed_name"] for m in alias["renamed_identity_matches"]] == ["1"]
    assert [m["observed_name"] for m in alias["cross_name_m5_length_inconsistencies"]] == ["2"]
    gap = diagnostics.dictionary_integrity(spark, path, put("gap.dict", f"@SQ\tSN:chr1\tLN:4\n@SQ\tSN:chr2\tLN:4\t{two}\n"))
    assert gap["missing_m5_sequences"] == ["chr1"] and not gap["has_conflict"] and not gap["content_verified"]


@pytest.mark.parametrize("text", ["", "@SQ\tSN:a\n", "@SQ\tSN:a\tLN:0\n", "@SQ\tSN:a\tLN:1\n@HD\tVN:1.0\n", "@PG\tID:x\n", "@SQ\tSN:a\tLN:1\n@SQ\tSN:a\tLN:1\n", "@SQ\tSN:a\tLN:1\tM5:zz\n", "@SQ\tSN:a\tSN:b\tLN:1\n", "chr1\n"])
def test_dictionary_rules(text):
    with pytest.raises(ParseError):
        headers.parse_header(text, "x.dict", only_dictionary=True)


def test_command_line(spark, put, capsys):
    path = put("base.fa", BASE)
    assert diagnostics.main(["inspect-fasta", path, "--format", "json"], spark) == 0
    assert '"collection_digest": "XZlrcEGi6mlopZ2uD8ObHkQB1d0oDwKk"' in capsys.readouterr().out
    assert diagnostics.main(["check-fai", path, put("bad.fai", "x\n")], spark) == 2
    assert diagnostics.main(["check-fai", path, put("other.fai", "chrX\t8\t6\t8\t9\n")], spark) == 0
    assert "missing_sequence" in capsys.readouterr().out


def plain_geometry(data):
    """Geometry of even FASTA bytes, line by line."""
    rows, at = [], 0
    for line in data.splitlines(keepends=True):
        body = line.rstrip(b"\r\n")
        if body.startswith(b">"):
            rows.append([(body[1:].split() or [b""])[0].decode(), 0, at + len(line), 0, 0])
        elif body:
            rows[-1][1] += len(body)
            if not rows[-1][3]:
                rows[-1][3:] = [len(body), len(line)]
        at += len(line)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("seed", range(4))
def test_files_in_many_splits(spark, put, seed):
    import random

    from anchorage.operators import refbases

    r = random.Random(seed)
    end = r.choice(["\n", "\r\n"])
    parts = []
    for k in range(r.choice([1, 40, 300])):
        bases = "".join(r.choice("ACGTNacgt") for _ in range(r.randint(1, 900)))
        width = r.randint(1, 80)
        parts.append(f">s{k}{r.choice(['', ' x y', chr(9) + 'é'])}{end}" + "".join(bases[i : i + width] + end for i in range(0, len(bases), width)))
    text = "".join(parts)
    data = (text if r.random() < 0.5 else text.removesuffix(end)).encode()
    path = put(f"{seed}.fa", data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = [tuple(x) for x in fasta.expected_index(spark, path).orderBy("ordinal").select("name", *fasta.GEOMETRY).collect()]
        assert got == plain_geometry(data)
        whole = fasta.bases(spark, path)
        assert sorted(map(tuple, fasta.file_identities(spark, path).collect())) == sorted(map(tuple, fasta.identities(whole).collect()))
        for chunk in (7, 100, 5000):
            want = refbases.chunked(whole, chunk).select("name", "number", "bases", "length").collect()
            assert sorted(map(tuple, fasta.chunks(spark, path, chunk).collect())) == sorted(map(tuple, want))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sequences_without_bases(spark, put):
    path = put("e.fa", ">a\n>b x\nAC\n\n>c\n")
    rows = {r["name"]: r for r in fasta.file_identities(spark, path).collect()}
    assert {k: (r["ordinal"], r["length"]) for k, r in rows.items()} == {"a": (0, 0), "b": (1, 2), "c": (2, 0)} and rows["a"]["md5"] == "d41d8cd98f00b204e9800998ecf8427e"
    assert sorted((r["name"], r["number"], r["bases"], r["length"]) for r in fasta.chunks(spark, path).collect()) == [("a", 0, "", 0), ("b", 0, "AC", 2), ("c", 0, "", 0)]
    for text in ("AC\n>a\nAC\n", ">a\nA\n>a\nC\n", ">\nA\n"):
        with pytest.raises(ParseError):
            fasta.file_identities(spark, put("bad.fa", text))


def test_headers_of_files_over_two_gigabytes(spark, tmp_path):
    """Sparse files: what lies behind the header is never read."""
    import struct

    text = b"@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:8\n"
    bam = gzip.compress(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 8))
    vcf = gzip.compress(b"##fileformat=VCFv4.3\n")
    for name, data, kind in (("big.bam", bam, "bam"), ("big.sam", text + b"r1\t0\tchr1\n", "sam")):
        path = tmp_path / name
        with open(path, "wb") as out:
            out.write(data)
            out.truncate(5 << 29)
        found = headers.read_alignment_header(spark, str(path), kind)
        assert [s[:2] for s in found.sequences] == [("chr1", 8)]
        path.unlink()
    from anchorage.sources import variants

    with open(tmp_path / "big.vcf.gz", "wb") as out:
        out.write(vcf)
        out.truncate(5 << 29)
    variants._refuse_bcf(spark, str(tmp_path / "big.vcf.gz"))


def test_bases_at_places(spark, put):
    import random

    from anchorage.errors import FetchError
    from anchorage.sources.identity import BaseReader

    r = random.Random(1)
    sequences = {f"s{k}": "".join(r.choice("ACGTn") for _ in range(r.randint(1, 400))) for k in range(6)}
    text = "".join(f">{n} x\r\n" + "".join(b[i : i + 37] + "\r\n" for i in range(0, len(b), 37)) for n, b in sequences.items())
    reader = BaseReader(spark, put("r.fa", text))
    for name, bases in sequences.items():
        assert reader.length(name) == len(bases) and reader.fetch(name, 0, len(bases)) == bases
        for _ in range(6):
            a, b = sorted(r.randint(0, len(bases)) for _ in "ab")
            assert reader.fetch(name, a, b) == bases[a:b]
    for name, a, b in (("s0", -1, 2), ("s0", 0, 401), ("s0", 3, 2), ("no", 0, 1)):
        with pytest.raises(FetchError):
            reader.fetch(name, a, b)


def test_another_provider_of_identities(spark, put):
    class Fixed:
        def identities(self, spark, path):
            return spark.createDataFrame([(0, "chrX", 8, "0" * 32, "SQ." + "A" * 32)], "ordinal long, name string, length long, md5 string, refget string")

    path = put("base.fa", BASE)
    assert [s["md5"] for s in diagnostics.fasta_identity(spark, path, Fixed())["sequences"]] == ["0" * 32]
    assert len(diagnostics.fasta_identity(spark, path)["sequences"]) == 3
