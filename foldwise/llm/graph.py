"""Connected components by alternating stars; links and labels stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import materialize

ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free sums of the links: equal marks mean an equal table."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(h, F.lit(2**31 - 1))), F.bit_xor(h)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node's neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    links = joined.select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(joined.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return links.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that has a link; the root is the smallest node of the component.

    ``edges`` has two columns of one ordered type; the direction, loops and repeats don't matter.
    A round costs two aggregations and two joins on the links, whatever the shape of the
    components, and the number of rounds grows with the logarithm of the longest path.
    """
    x, y = edges.columns
    now = edges.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    now = materialize(now)
    mark = _mark(now)
    for _ in range(ROUNDS):
        if mark[0] == 0:
            break
        now = materialize(_small_star(_large_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = now.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
