"""Connected components over a distributed edge table.

Alternates two contractions of the edge set until it is a set of stars: each
node hands its larger neighbours to its least neighbour, then its smaller
ones.  Every step is an aggregation (least neighbour per node, pre-aggregated
before the shuffle) and an equi-join back; nothing is collected but two
totals per round.  Edges only get fewer and the number of rounds grows with
the logarithm of the longest path.

Defined results: loops and repeated edges change nothing; nodes without edges
do not appear; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import cut, drop_scratch


def _hand_over(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction.  ``edges``: distinct (u, v) with u > v, and the result again."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # Dealt out once more, so that Spark can split the edges of a node with very many among tasks of the join.
    joined = both.join(least.hint("rebalance"), "u")
    if larger:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return made.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _totals(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with an edge; the component is its least node."""
    now = cut(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(),
        "edges",
    )
    seen, changed = _totals(now), True
    while changed:
        after = cut(_hand_over(_hand_over(now, True), False), "edges")
        drop_scratch(now)
        totals = _totals(after)
        now, seen, changed = after, totals, totals != seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
