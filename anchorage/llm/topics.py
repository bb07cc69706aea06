"""Topics for mixing: spherical k-means over hashed words, fitted on all documents.

A text's long words are counted in ``BUCKETS`` buckets by a hash.  A count
weighs by its logarithm and by how few documents have the bucket; a document is
its weights at length one.  The first topic of a document is the bucket of its
most frequent long word; ``ROUNDS`` times, topics are the sums of their
documents and documents go to the nearest topic.

Sums are of whole numbers, so topics are the same however the documents lie in
partitions.  Of a round, a task sends at most ``TOPICS * BUCKETS`` sums, and as
many reach the driver in all.

Defined results: a text without long words has topic 0 and counts for none; of
words as frequent the least in byte order counts; of topics as near the first;
a topic without documents stays where it was.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOPICS, BUCKETS, LONG_WORD, ROUNDS = 8, 1024, 6, 3
#: Whole numbers that stand for 1: of weights, and of a document's length.
ONE = 1 << 10


def words_of(text: str | None) -> tuple[int, Counter[bytes]]:
    """The number of words, and how often each long one occurs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return len(words), Counter(w for w in words if len(w) >= LONG_WORD)


def first_topic(counts: Counter[bytes]) -> int:
    if not counts:
        return 0
    most = max(counts.values())
    return zlib.crc32(min(w for w, n in counts.items() if n == most)) % TOPICS


def vector(counts: Counter[bytes]) -> tuple[list[int], list[int]]:
    """Buckets in order and their counts."""
    held: dict[int, int] = {}
    for word, n in counts.items():
        bucket = zlib.crc32(word) % BUCKETS
        held[bucket] = held.get(bucket, 0) + n
    buckets = sorted(held)
    return buckets, [held[b] for b in buckets]


class Topics:
    """Weights of buckets and, once fitted, the topics at length one."""

    def __init__(self, rarity: np.ndarray, centres: np.ndarray | None = None):
        self.rarity, self.centres = rarity, centres

    def weights(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A document at length one, in whole numbers."""
        weight = np.log2(1.0 + counts) * self.rarity[buckets]
        length = np.sqrt((weight * weight).sum())
        return np.rint(weight * (ONE / length)).astype(np.int64) if length else np.zeros(len(buckets), np.int64)

    def nearest(self, buckets: np.ndarray, weights: np.ndarray) -> int:
        return int(np.argmax((self.centres[:, buckets] * weights).sum(axis=1))) if weights.any() else 0

    def moved(self, sums: np.ndarray) -> Topics:
        """With the topics where the sums of their documents say."""
        length = np.sqrt((sums.astype(float) ** 2).sum(axis=1, keepdims=True))
        old = self.centres if self.centres is not None else np.zeros((TOPICS, BUCKETS))
        return Topics(self.rarity, np.where(length > 0, sums / np.maximum(length, 1e-300), old))


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First topic, buckets and counts of the rows of ``first, buckets, counts``."""
    lists, counts = batch.column(1), batch.column(2)
    at, flat, each = lists.offsets.to_numpy(), lists.values.to_numpy(), counts.values.to_numpy()
    for k, first in enumerate(batch.column(0).to_pylist()):
        yield first, flat[at[k] : at[k + 1]], each[at[k] : at[k + 1]]


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> Topics:
    """Topics of a written table ``first, buckets, counts``."""
    total = vectors.count()
    held = {r["bucket"]: r["n"] for r in vectors.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a bucket
    rarity = np.array([np.rint(ONE * np.log2((1 + total) / (1 + held.get(b, 0)) + 1)) for b in range(BUCKETS)])
    topics = Topics(rarity)
    for _ in range(rounds):

        def sums(batches: Iterable[pa.RecordBatch], topics: Topics = topics) -> Iterator[pa.RecordBatch]:
            found = np.zeros((TOPICS, BUCKETS), np.int64)
            for batch in batches:
                for first, buckets, counts in _documents(batch):
                    weights = topics.weights(buckets, counts)
                    found[first if topics.centres is None else topics.nearest(buckets, weights), buckets] += weights
            topic, bucket = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(topic.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(found[topic, bucket])], names=["topic", "bucket", "held"])

        rows = vectors.select("first", "buckets", "counts").mapInArrow(sums, "topic int, bucket int, held long").groupBy("topic", "bucket").agg(F.sum("held").alias("held")).collect()
        whole = np.zeros((TOPICS, BUCKETS), np.int64)
        for r in rows:
            whole[r["topic"], r["bucket"]] = r["held"]
        topics = topics.moved(whole)
    return topics


def assign(vectors: DataFrame, topics: Topics) -> DataFrame:
    """``vectors`` with ``topic`` in place of ``first, buckets, counts``."""

    @F.pandas_udf("int")
    def of(buckets: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([topics.nearest(np.asarray(b), topics.weights(np.asarray(b), np.asarray(c))) if len(b) else 0 for b, c in zip(buckets, counts, strict=True)], dtype="int32")

    return vectors.withColumn("topic", of("buckets", "counts")).drop("first", "buckets", "counts")
