"""Connected components of a graph given as edges between long node ids.

Defined cases: loops and repeated edges count once; an empty table gives no rows; nulls are
no nodes: edges with one are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, are tied
    to the smallest node known there. Minima are combined before the shuffle."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    tied = large.join(lowest, "a")
    return (
        tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(lowest.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node that has an edge and is not its component's
    smallest node. ``edges`` has long columns a and b. Each round is written to the
    shared folder; it ends when a round changes nothing."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if mark == seen or seen["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
        now = written(_stars(now), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
