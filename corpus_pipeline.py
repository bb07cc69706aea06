"""From raw documents to token ids: rules, near duplicates, secrets, mixture, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; :func:`run`
writes what a stage returns and gives it, read again, to the next.  All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.llm import bpe, jaccard, mixing, quality, secrets
from anchorage.llm.common import cut, quoted, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept_documents(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal sets of five-word shingles (0.8 or more), the one with the least id stays.

    Rows with a null id stay; of rows that repeat an id and stay, all do.
    """
    found = jaccard.link_components(docs, width=5, num=80, den=100)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return jaccard.by_ids(docs, cut(gone, "gone"), "doc_id", "left_anti").select(*map(quoted, docs.columns))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and topics meet their target tokens."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: token ids of the byte-level BPE, and the text they decode to."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: Joining by similarity, inferred automata, raking and merging are beyond one SQL statement; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
