"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.scratch import Scratch


#: Up to so many edges (counted each round) a round is one task and shuffles nothing.
FEW_EDGES = 200_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a long, b long; any order).

    Large-star and small-star steps alternate until nothing changes: each is one minimum per node and
    one join, so a node with any number of neighbours is never collected. Loops and repeated edges do
    no harm; no edges give no nodes. Chains take about log2(length) rounds.
    """
    now = scratch.keep(_distinct(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    before = None
    while (mark := _mark(now)) != before:
        before, old = mark, now
        now = scratch.keep(_small_star(_large_star(now.coalesce(1) if mark[0] <= FEW_EDGES else now)))
        scratch.drop(old)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").distinct()


def _mark(edges: DataFrame) -> tuple:
    one = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(one), F.sum(F.pmod(one, F.lit(1 << 31)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = edges.select(ways.alias("e")).select("e.a", "e.b")
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    out = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b"))
    return _distinct(out)


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges lead from a to smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    ties = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return _distinct(ties)
