"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def connected_components(edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """(node, component) for nodes that are not the smallest of their component; edges are (a, b).

    Every step writes a table, so lineage stays short; nothing but one row of counts reaches the driver. The larger node
    of an edge keeps one edge to the smallest node it knows, which ends in stars around the smallest nodes.
    """
    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).first()

    oriented = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, step = workspace.store(oriented, f"{name}_0"), 0
    seen = state(current)
    while seen[0]:
        step += 1
        after = workspace.store(_small_star(_large_star(current)), f"{name}_{step}")
        workspace.drop(f"{name}_{step - 1}")
        current, before, seen = after, seen, state(after)
        if seen == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
