"""Connected components of a table of links, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Every round first hangs the larger neighbours of a node on its smallest neighbour, then
    the smaller ones, until nothing moves; paths halve each time. A hub with many links is
    one row of a minimum and the split side of a join, never a gathered list.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    while not _is_settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.filter("u > v")
        root = hung.groupBy("u").agg(F.min("v").alias("m"))
        rest = hung.join(root, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(rest.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _is_settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one other, and that one on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    per_node = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return per_node.filter("hangs > 1 or hangs = 1 and holds = 1").isEmpty()
