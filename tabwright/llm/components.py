"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import written


def _least(pairs: DataFrame) -> DataFrame:
    """``(u, v, m)`` with the least neighbour of each ``u``, itself included. Minima are combined
    before the shuffle; adaptive execution splits the join of a node with very many links."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of ``links (a, b)``; the label is the least node reachable.

    Alternates two steps that hang nodes onto the least node in reach, first over the greater
    neighbours and then over the lesser ones, until the links are stars. Every round is written
    to the shared folder; the number of rounds grows with the logarithm of the longest path.
    """
    pairs = written(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        up = up.distinct()
        down = _least(up)
        down = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).filter("u <> v")
        pairs = written(down.distinct(), "links")
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state = now
    labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
