import base64
import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anchorage.functions import digests
from anchorage.plans.model import digest, json_array, quoted
from anchorage.sources.annotation import decode_seqid


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("text", ["", "acgt", "A-C*G\n t", "ßéA"])
def test_normal_form_and_digests(spark, text):
    plain = "".join(c for c in text if c.isascii() and c.isalpha()).upper()
    assert one(spark, digests.normalized(F.col("t")), t=text) == plain
    assert one(spark, digests.sequence_md5(F.col("t")), t=text) == hashlib.md5(plain.encode()).hexdigest()
    assert one(spark, digests.refget_id(F.col("t")), t=text) == "SQ." + base64.urlsafe_b64encode(hashlib.sha512(plain.encode()).digest()[:24]).decode()


def test_reduction(spark):
    assert one(spark, digests.reduced(F.col("t")), t="acgtnBDHKMRSVWY") == "ACGTNCAAGAACAAC"
    assert one(spark, digests.reducible(F.col("t")), t="ACGTryN") is True and one(spark, digests.reducible(F.col("t")), t="AU") is False


def test_md5_validity_and_gzip(spark):
    assert one(spark, digests.valid_md5(F.col("t")), t="A" * 32) == "a" * 32 and one(spark, digests.valid_md5(F.col("t")), t="x" * 32) is None
    assert one(spark, digests.is_gzip(F.unhex(F.col("t"))), t="1F8B08") is True and one(spark, digests.is_gzip(F.unhex(F.col("t"))), t="00") is False


@pytest.mark.parametrize("parts", [["a"], ["a", "b"], ['q"uote', "back\\slash", "ünï"[:0]]])
def test_ids_agree_on_both_sides(spark, parts):
    want = digests.stable_id("x", parts)
    assert want == "x:" + hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, digests.stable_id_column("x", *[F.lit(p) for p in parts])) == want
    assert one(spark, digest("x", *[quoted(F.lit(p)) for p in parts])) == want
    nested = digests.stable_id("x", ["k", parts])
    assert one(spark, digest("x", quoted(F.lit("k")), json_array(F.array(*[F.lit(p) for p in parts])))) == nested


def test_attributes(spark):
    assert one(spark, digests.attribute(F.col("t"), "ID"), t="a=1; ID=x;ID=y;IDE=z") == ["x", "y"]


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=12))
def test_sequence_ids_round_trip(name):
    keep = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.:^*$@!+_?-|")
    try:
        data = name.encode()
    except UnicodeEncodeError:
        return
    escaped = "".join(chr(b) if chr(b) in keep else f"%{b:02X}" for b in data)
    assert decode_seqid(escaped) == (name, None)


@pytest.mark.parametrize("raw", ["", "a b", "%4", "%zz", "%41", "%ff", "a%2Db"])
def test_bad_sequence_ids(raw):
    assert decode_seqid(raw)[0] is None and decode_seqid(raw)[1]
