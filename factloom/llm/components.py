"""Connected components of an edge table by alternating large and small stars, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm._shared import keep


def _star(pairs: DataFrame) -> DataFrame:
    """(node, near) with the least of node and its neighbours."""
    least = pairs.groupBy("node").agg(F.min("near").alias("least")).select("node", F.least("node", "least").alias("least"))
    return pairs.join(least, "node")


def _both_ways(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """(node, near) for each pair, from either end, by one scan."""
    ends = F.array(F.struct(F.col(first).alias("node"), F.col(second).alias("near")), F.struct(F.col(second).alias("node"), F.col(first).alias("near")))
    return pairs.select(F.explode(ends).alias("x")).select("x.node", "x.near")


def _settled(now: DataFrame) -> bool:
    """Whether all edges (a, b) are those of stars: no a has two, and none is the b of another."""
    ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("out")), F.struct(F.col("b").alias("node"), F.lit(0).alias("out")))).alias("x")).select("x.node", "x.out")
    by_node = ends.groupBy("node").agg(F.sum("out").alias("out"), F.count("*").alias("all"))
    return by_node.where("out > 1 OR out = 1 AND all > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the least node of its component, itself included.

    A node's neighbours are never gathered: both steps take a minimum with map-side
    aggregation and join it back, a join whose skewed keys Spark splits. The rounds end
    when the edges are stars; as each goes to a smaller node, its centre is the least.
    Stars to begin with take none: the driver's memory goes with the number of jobs.
    """
    now = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _settled(now):
        large = _star(_both_ways(now, "a", "b")).where(F.col("near") > F.col("node")).select(F.col("near").alias("node"), F.col("least").alias("near")).distinct()
        small = _star(large)
        joined = small.select(F.explode(F.array("near", "node")).alias("a"), F.col("least").alias("b"))
        now = keep(joined.where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
