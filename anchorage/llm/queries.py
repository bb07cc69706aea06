"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.llm import bpe, html, jaccard, langid, merkle, mixing, quality, secrets, tokenfiles, viterbi
from anchorage.llm.common import table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weigh(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.write_and_read(table(spark, sf_dir, "documents"), added=True)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.count_tokens(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_digests(table(spark, sf_dir, "documents"), repeated=True)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_rules": op3_quality_rules,
    "op4_html_extraction": op4_html_extraction,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_secret_scan": op8_secret_scan,
    "op9_fingerprints": op9_fingerprints,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality.ORACLE_SQL,
    "op9_fingerprints": merkle.ORACLE_SQL,
}
