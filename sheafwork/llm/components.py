"""Connected components of an edge table, by alternating large and small stars.

Each round is two aggregations by node (minimum, combined before the shuffle) and two joins; edges never outnumber the
input's, a node with very many neighbours is only ever aggregated or joined (which Spark can split), and the number of
rounds grows with the logarithm of the longest path; edges that are stars already need none. Every round is written to the shared folder, so no lineage grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.session import cut_lineage


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node points to two others, or points and is pointed to: then the edges are not stars yet."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    counted = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return not counted.filter((F.col("out") > 1) | (F.col("out") > 0) & (F.col("in") > 0)).isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large or small star of edges (u, v) with u > v."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m"))
    joined = around.join(least, "u").withColumn("m", F.least("u", "m"))
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is its smallest node.

    Null ends and loops are dropped; repeated and reversed edges count once; no edges give no rows.
    """
    now = cut_lineage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct())
    while _unfinished(now):
        now = cut_lineage(_star(_star(now, large=True), large=False))
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
