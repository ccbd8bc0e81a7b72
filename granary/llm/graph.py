"""Connected components over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import forget, stored


def grown(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) of a graph as they are with further edges (a, b): the old ones are stars already, so few steps are needed; ``roots`` goes."""
    if edges.isEmpty():
        return roots
    out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(edges.select("a", "b")))
    forget(roots)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the undirected edges (a, b).

    Alternates the large-star and small-star steps: each links a node's neighbours to the
    smallest of them, larger ones first, then the smaller ones, until nothing changes. A step
    is one aggregation (with partial sums, so a node of many edges is no burden) and one join.
    Only whether they are done goes to the driver.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        after = stored(large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), "edges")
        # done once every node hangs on one root that hangs on nothing
        ends = after.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(after.select("b", F.lit(0), F.lit(1)))
        loose = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1")
        done = loose.isEmpty()
        forget(now, large)
        if done:
            roots = after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            out = after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
            out._granary_path = after._granary_path
            return out
        now = after
