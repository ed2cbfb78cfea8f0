"""Graph work on stored edge tables: components, and the groups that a scan in id order would form.

Edges are rows (v, u), u the smaller end. Rounds read edges and ids only, never what the edges were made from, and every round is
written to the shared folder. Nothing gathers a node's edges: decisions are minima and counts with a map-side combine.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.session import cut_lineage

#: Edges of a component that one task settles by itself.
EDGES_AT_ONCE = 200_000
#: Rounds over all open edges before what is left is looked at by component.
ROUNDS = 3


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (v, u) with the smallest node of its component.

    Labels go to the smallest among the neighbours' and then to that label's own, so they halve long paths each round.
    """
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u"))).filter("u <> v")
    both = cut_lineage(both.distinct())
    labels = cut_lineage(both.groupBy(F.col("v").alias("node")).agg(F.least(F.min("u"), F.col("v")).alias("root")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("u"), "root"), "u").groupBy(F.col("v").alias("node")).agg(
            F.min("root").alias("near"))
        nearer = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # what a node learns its former root learns too, so that whole trees move and not only their leaves
        told = nearer.groupBy(F.col("was").alias("node")).agg(F.min("root").alias("told"))
        moved = cut_lineage(nearer.join(told, "node", "left").select(
            "node", F.least("root", F.coalesce("told", "root")).alias("root"), "was"))
        jump = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = cut_lineage(moved.join(jump, "root").select("node", "was", F.least("root", "next").alias("root")))
        if after.filter("root <> was").isEmpty():
            return after.select("node", "root")
        labels = after.select("node", "root")


def _scan(group: pd.DataFrame) -> pd.DataFrame:
    """(id, owner) of the nodes of one component that its rows (v, u, ended, primary) settle; a row without u names a node."""
    group = group.sort_values(["v", "u"], na_position="first", ignore_index=True)
    v, u = group["v"].to_numpy(), group["u"].fillna(-1).to_numpy(dtype="int64")
    given, primary, ended = group["u"].notna().to_numpy(), group["primary"].to_numpy(bool), group["ended"].to_numpy(bool)
    owner: dict[int, int | None] = {}
    first = 0
    while first < len(v):
        node, at = int(v[first]), first
        owner[node] = node if ended[first] else None
        while at < len(v) and v[at] == node:
            if given[at]:
                other = int(u[at])
                its = other if primary[at] else owner[other]
                if its is None or its == other:  # undecided, or the first primary near it
                    owner[node] = its
                    at = int(np.searchsorted(v, node, "right"))
                    break
            at += 1
        first = at
    found = [(i, o) for i, o in owner.items() if o is not None]
    return pd.DataFrame(found, columns=["id", "owner"], dtype="int64")


def scan_groups(edges: DataFrame, unended: DataFrame | None = None, edges_at_once: int = EDGES_AT_ONCE
                ) -> tuple[DataFrame, DataFrame | None]:
    """The groups that a scan over ids finds: a node is a primary unless an earlier primary is its neighbour, and belongs
    to the first such primary.

    Returns (id, owner) of the settled nodes, owner = id for primaries, and (v) of the others, None when there are none: ``unended``
    lists nodes (v) whose edges are only their first ones; such a node stays open when all of those lead to duplicates, and so
    do nodes that depend on it.

    A round settles the nodes whose first edge that does not lead to a duplicate leads to a primary, and those without such an
    edge. After a few rounds the open edges are split into components, and small ones are settled whole in one task each,
    so a long chain takes no more rounds than a short one. Null ends and loops are no edges; repeated edges count once.
    """
    edges = edges.filter("u < v").select("v", "u").distinct()
    if unended is None:
        edges = cut_lineage(edges.withColumn("ended", F.lit(True)))
    else:
        flags = unended.select("v", F.lit(False).alias("ended")).distinct()
        edges = cut_lineage(edges.join(flags, "v", "left").select("v", "u", F.coalesce("ended", F.lit(True)).alias("ended")))
    later = edges.select(F.col("v").alias("u")).distinct()
    settled = cut_lineage(edges.select("u").distinct().join(later, "u", "left_anti").select(
        F.col("u").alias("id"), F.col("u").alias("owner")))
    rounds = 0
    while not edges.isEmpty():
        owners = settled.select(F.col("id").alias("u"), "owner")
        known = edges.join(owners, "u", "left").withColumn("primary", F.coalesce(F.col("owner") == F.col("u"), F.lit(False)))
        usable = F.when(F.col("owner").isNull() | F.col("primary"), F.struct("u", "primary"))
        state = known.groupBy("v").agg(F.min("ended").alias("ended"), F.min(usable).alias("f"))
        new = cut_lineage(state.filter("f.primary or (f is null and ended)").select(
            F.col("v").alias("id"), F.coalesce("f.u", "v").alias("owner")))
        rounds += 1
        if rounds % ROUNDS == 0 or new.isEmpty():
            open_edges = known.filter("owner is null or primary").select("v", "u", "ended", "primary")
            names = edges.select("v", F.lit(None).cast("bigint").alias("u"), "ended", F.lit(False).alias("primary")).distinct()
            roots = smallest_reachable(open_edges.filter("not primary")).withColumnRenamed("node", "v")
            placed = open_edges.union(names).join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
            small = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= edges_at_once).select("root")
            new = cut_lineage(placed.join(small, "root").select("root", "v", "u", "ended", "primary").groupBy("root").applyInPandas(
                _scan, "id bigint, owner bigint"))
            if new.isEmpty():
                return settled, cut_lineage(edges.select("v").distinct())
        settled = cut_lineage(settled.union(new))
        edges = cut_lineage(edges.join(new.select(F.col("id").alias("v")), "v", "left_anti"))
    return settled, None
