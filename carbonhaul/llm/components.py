"""Connected components of a graph of ids by alternating stars.

Each round links every node's larger neighbours to its smallest one, then every node's smaller
neighbours; the graph ends as stars around the smallest id of each component. A round is two
aggregations and joins over the edges, staged in the shared folder; their number never grows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import staged


def components(edges):
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node."""
    current = staged(
        edges.where("a <> b").select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).distinct(),
        "component-edges",
    )
    while not _stars(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        )
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        # the node itself, and each of its smaller neighbours, to the smallest of them
        small = large.join(smallest, "u")
        current = staged(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(smallest.select("u", F.col("m").alias("v")))
            .distinct(),
            "component-edges",
        )
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return staged(leaves.unionByName(roots), "components")


def _stars(edges):
    """Whether every node has one smaller neighbour, or larger ones only."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    other = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return other.where("up > 1 OR up > 0 AND down > 0").agg(F.count("*")).first()[0] == 0
