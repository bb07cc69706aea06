"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  From the tokens of
each cell, counted over all documents, raking finds one inclusion rate per
cell so that the expected tokens meet a target for every source, every
language and every topic: each sweep scales the rates of one margin after the
other to its targets, and no rate may exceed 1.  A document is then sampled if
a uniform draw, a hash of seed and ``doc_id``, lies below its cell's rate, so
the sample is the same however often and wherever it is computed.

Default targets: ``SHARE`` of all tokens in total, spread over the values of a
margin in proportion to their tokens to the power ``FLATTEN`` (less than 1
favours small sources), none above ``ROOM`` of what it has: margins that go
together, as topics and languages do, can then be met at once.  Any table of
target shares can be given instead.

Topics come from a clustering of all documents by their words
(:mod:`anchorage.llm.topics`), or from a fitted one that is given.

Cells are aggregated before the shuffle, so a source with a third of all rows
costs no more than another.  Up to ``CELLS_AT_DRIVER`` cells are raked in
numpy on the driver and broadcast; more are raked as a table, sweep by sweep.

Targets that no rates of at most 1 can meet at once, or that ``SWEEPS`` sweeps
don't reach, are not met: :func:`margins` shows target and expectation of every
value, and a gap over ``TOLERATED`` is a warning.  Tokens are white-space words,
or whatever ``count`` says of a text (any tokenizer's count).

Defined results: a null source or language counts as the empty string; a null
or empty text has no tokens and topic 0; a null ``doc_id`` has the draw of the
seed alone; repeated rows are drawn alike; other columns are kept by
:func:`sample` and ignored by :func:`weigh`; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from anchorage.llm import topics
from anchorage.llm.common import cut, drop_scratch, quoted

MARGINS = ("source", "lang", "topic")
SHARE, FLATTEN, ROOM, SEED = 0.75, 0.7, 0.85, 11
SWEEPS, CLOSE, TOLERATED = 200, 1e-6, 0.01
CELLS_AT_DRIVER = 200_000


_FEATURES = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


def _features(texts: Column, count: Callable[[str], int] | None = None) -> Column:
    def row(text: object) -> tuple:
        own = text if isinstance(text, str) else ""
        words, long = topics.words_of(own)
        return (count(own) if count else words, topics.first_topic(long), *topics.vector(long))

    @F.pandas_udf(_FEATURES)
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([row(t) for t in texts], columns=["n_tokens", "first", "buckets", "counts"])

    return of(texts.cast("string"))


def _margin(docs: DataFrame, name: str) -> Column:
    return F.coalesce(docs[name].cast("string"), F.lit(""))


def features(docs: DataFrame, count: Callable[[str], int] | None = None, rows: bool = False) -> DataFrame:
    """``doc_id, source, lang, n_tokens`` and a vector of words, and with ``rows`` each row itself as ``_row``; written once."""
    own = [F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("_row")] if rows else []
    view = docs.select(*own, docs["doc_id"].cast("long").alias("doc_id"), _margin(docs, "source").alias("source"), _margin(docs, "lang").alias("lang"), _features(docs["text"], count).alias("f"))
    return cut(view.select(*(["_row"] if rows else []), "doc_id", "source", "lang", "f.*"), "features")


def default_targets(tokens: np.ndarray, share: float = SHARE, flatten: float = FLATTEN) -> np.ndarray:
    """Target tokens of the values of one margin: flattened, none above ``ROOM`` (or ``share``, if more) of its tokens, ``share`` of all in total."""
    total, target, most = share * tokens.sum(), np.zeros(len(tokens)), max(share, ROOM) * tokens
    open_ = tokens > 0
    while open_.any() and total - target.sum() > 1e-9 * max(total, 1):
        weight = np.where(open_, tokens.astype(float) ** flatten, 0.0)
        target = target + (total - target.sum()) * weight / weight.sum()
        open_ = open_ & (target < most)
        target = np.minimum(target, most)
    return target


def rake(tokens: np.ndarray, labels: list[np.ndarray], targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Rates per cell; ``labels[d]`` gives each cell's value of margin d, ``targets[d]`` the tokens wanted of each value."""
    rate = np.full(len(tokens), min(1.0, targets[0].sum() / max(tokens.sum(), 1)))
    for _ in range(sweeps):
        worst = 0.0
        for label, target in zip(labels, targets, strict=True):
            got = np.bincount(label, tokens * rate, len(target))
            factor = np.divide(target, got, out=np.zeros(len(target)), where=got > 0)
            worst = max(worst, float(np.abs(factor - 1)[target > 0].max(initial=0)))
            rate = np.minimum(1.0, rate * factor[label])
        if worst < CLOSE:
            break
    return rate


def _tell(gaps: list[tuple[str, float]]) -> None:
    """Warn of targets that the rates miss."""
    missed = [(m, gap) for m, gap in gaps if gap > TOLERATED]
    if missed:
        warnings.warn("targets not met: " + ", ".join(f"{m} by up to {gap:.1%}" for m, gap in missed), stacklevel=3)


def _rake_on_driver(cells: DataFrame, wanted: dict[str, dict] | None) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: tuple(map(str, (r[m] for m in MARGINS))))
    tokens = np.array([r["tokens"] for r in rows], float)
    labels, targets = [], []
    for m in MARGINS:
        values = sorted({r[m] for r in rows})
        at = {v: i for i, v in enumerate(values)}
        label = np.array([at[r[m]] for r in rows], int)
        have = np.bincount(label, tokens, len(values))
        labels.append(label)
        targets.append(np.array([wanted[m].get(v, 0.0) for v in values]) * SHARE * tokens.sum() if wanted and m in wanted else default_targets(have))
    rates = rake(tokens, labels, targets) if rows else []
    if rows:
        _tell([(m, float(np.max(np.abs(np.bincount(label, tokens * rates, len(t)) / np.maximum(t, 1e-300) - 1)[t > 0], initial=0))) for m, label, t in zip(MARGINS, labels, targets, strict=True)])
    made = [(*(r[m] for m in MARGINS), float(p)) for r, p in zip(rows, rates, strict=True)]
    return F.broadcast(cells.sparkSession.createDataFrame(made, "source string, lang string, topic int, probability double"))


def _rake_as_table(cells: DataFrame, wanted: dict[str, dict] | None) -> DataFrame:
    """The same, with the cells left in a table; every sweep is written down."""
    spark = cells.sparkSession
    targets = {}
    for m in MARGINS:
        have = cells.groupBy(m).agg(F.sum("tokens").alias("have")).orderBy(m).collect()  # one row per value of a margin
        tokens = np.array([r["have"] for r in have], float)
        goal = np.array([wanted[m].get(r[m], 0.0) for r in have]) * SHARE * tokens.sum() if wanted and m in wanted else default_targets(tokens)
        targets[m] = spark.createDataFrame([(r[m], float(g)) for r, g in zip(have, goal, strict=True)], f"{m} {'int' if m == 'topic' else 'string'}, target double")
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cut(cells.withColumn("rate", F.lit(min(1.0, targets["source"].agg(F.sum("target")).first()[0] / max(total, 1)))), "rates")
    for _ in range(SWEEPS):
        worst = 0.0
        for m in MARGINS:
            factors = cut(
                now.groupBy(m).agg(F.sum(F.col("tokens") * F.col("rate")).alias("got")).join(targets[m], m).select(m, "target", F.when(F.col("got") > 0, F.col("target") / F.col("got")).otherwise(0.0).alias("factor")), "factors"
            )
            worst = max(worst, factors.where("target > 0").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            now = cut(now.join(factors.select(m, "factor"), m).withColumn("rate", F.least(F.lit(1.0), F.col("rate") * F.col("factor"))).select(*MARGINS, "tokens", "rate"), "rates")
        if worst < CLOSE:
            break
    _tell(
        [
            (m, now.groupBy(m).agg(F.sum(F.col("tokens") * F.col("rate")).alias("got")).join(targets[m], m).where("target > 0").agg(F.max(F.abs(F.col("got") / F.col("target") - 1))).first()[0] or 0.0)
            for m in MARGINS
        ]
    )
    return now.select(*MARGINS, F.col("rate").alias("probability"))


def rates(described: DataFrame, wanted: dict[str, dict] | None = None, at_driver: int = CELLS_AT_DRIVER) -> DataFrame:
    """``source, lang, topic, probability`` of every cell.  ``wanted``: per margin, the share of each value, summing to 1."""
    cells = cut(described.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    few = cells.limit(at_driver + 1).count() <= at_driver
    return _rake_on_driver(cells, wanted) if few else _rake_as_table(cells, wanted)


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) fixed by seed and document."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), doc_id.cast("long")), 11) * F.lit(2.0**-53)


def weigh(
    docs: DataFrame, wanted: dict[str, dict] | None = None, seed: int = SEED, at_driver: int = CELLS_AT_DRIVER, count: Callable[[str], int] | None = None, fitted: topics.Topics | None = None
) -> DataFrame:
    """Every document with its cell, its tokens, the calibrated probability and whether it is sampled."""
    held = features(docs, count)
    described = cut(topics.assign(held, fitted or topics.fit(held)), "described")
    drop_scratch(held)
    joined = described.join(rates(described, wanted, at_driver), list(MARGINS))
    return joined.select("doc_id", *MARGINS, "n_tokens", "probability", (draw(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def margins(weighed: DataFrame, wanted: dict[str, dict] | None = None) -> DataFrame:
    """``margin, value, tokens, target, expected`` of every value of every margin, from what :func:`weigh` gives."""
    spark, parts = weighed.sparkSession, []
    for m in MARGINS:
        rows = weighed.groupBy(F.col(m).cast("string").alias("value")).agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected")).orderBy("value").collect()  # one row per value of a margin
        tokens = np.array([r["tokens"] for r in rows], float)
        given = {str(k): v for k, v in wanted[m].items()} if wanted and m in wanted else None
        target = np.array([given.get(r["value"], 0.0) for r in rows]) * SHARE * tokens.sum() if given is not None else default_targets(tokens)
        parts += [(m, r["value"], r["tokens"], float(t), float(r["expected"])) for r, t in zip(rows, target, strict=True)]
    return spark.createDataFrame(parts, "margin string, value string, tokens long, target double, expected double")


def sample(
    docs: DataFrame, wanted: dict[str, dict] | None = None, seed: int = SEED, at_driver: int = CELLS_AT_DRIVER, count: Callable[[str], int] | None = None, fitted: topics.Topics | None = None
) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns.

    Rows and features are written once, so that each text is looked at once.
    """
    held = features(docs, count, rows=True)
    described = topics.assign(held, fitted or topics.fit(held))
    found = rates(described.drop("_row"), wanted, at_driver)
    joined = described.select("_row", "doc_id", *MARGINS).join(found, list(MARGINS))
    return joined.where(draw(F.col("doc_id"), seed) < F.col("probability")).select("_row.*")
