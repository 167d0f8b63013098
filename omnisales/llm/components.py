"""Connected components of a graph of document ids, as joins and groupings (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns ``a`` and ``b``. Returns ``node``, ``component`` (smallest id reachable) of all ids in it.

    Each round hooks every node's larger neighbours, then its smaller ones, onto the smallest; the number of rounds
    grows with the logarithm of the longest path. Rounds end when every node is hooked to one that is hooked to none.
    Minima are taken before the shuffle, so a node that a third of all edges meet sends one row a task; the join by
    node is one that Spark can split.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while _unsettled(now):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = written(large, "large-star")
        root = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(root, "a")
        now = written(small.select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")),
                                                     F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
                      .select("e.*").where("a <> b").distinct(), "small-star")
    return (now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))


def _unsettled(edges: DataFrame) -> bool:
    """Whether a node has two edges to smaller ones, or one of each kind: edges of stars have neither."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                                          F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    met = ends.select("e.*").groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not met.where((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1)).isEmpty()
