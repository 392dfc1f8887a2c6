"""Connected components of a graph given as edges, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_spread

#: Rounds after which we give up. Each round at least halves the longest chain, up to a constant.
MOST_ROUNDS = 200


def _with_least(rows: DataFrame, edges: DataFrame, least: Column) -> DataFrame:
    """Rows of edges with `m`, the least over all edges of the same `a`. No task gets all rows of a hot node."""
    stars = edges.groupBy("a").agg(least.alias("m"), F.count("*").alias("_n"))
    return join_spread(rows, stars, "a", "_n", "b").select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of a node to the node's least neighbour (or itself)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = _with_least(both.filter("b > a"), both, F.least(F.min("b"), F.min("a")))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its lesser neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _with_least(down, down, F.min("b"))
    moved = found.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionAll(found.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is its least reachable node.

    edges: two columns of longs. Alternates the large-star and small-star operations until the
    edges are stars; rounds grow with the logarithm of the longest path. Lineage is cut by a
    reliable checkpoint a round, and the end is told by counts and sums of hashes. Nulls, loops
    and repeated edges are ignored.
    """
    a, b = edges.columns
    now = checkpoint(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
    seen = mark(now)
    for _ in range(MOST_ROUNDS):
        now = checkpoint(_small_star(_large_star(now))) if seen[0] else now
        new = mark(now)
        if new == seen:  # the same set of edges: counts and two 128-bit sums agree
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = new
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
