"""Connected components of an edge table, by alternating large-star and small-star steps.

Both steps are a grouped minimum and a join, so hubs are pre-aggregated before
the shuffle and their joins can be split by the adaptive planner.  Each round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than u is linked to the smallest of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them (edges run from the greater end a to b)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("w"), "m")
    rest = edges.join(least, F.col("a") == F.col("w")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select(F.col("w").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in (a, b), component being its smallest node.

    Self-loops and nulls are left out, repeated and reversed edges count once;
    an empty edge table gives an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = staged(edges.distinct(), "components")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        edges = staged(_small_star(_large_star(edges)), "components")
        mark, old = _mark(edges), mark
        if mark == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Now every edge runs from a node to the smallest of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
