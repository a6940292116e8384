"""Connected components by contraction, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch, small


def smallest_reachable(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (u, v): the smallest node that it reaches.

    Each round every node hooks onto its smallest neighbour (never a larger
    node than itself), two jumps shorten the chains, and edges are renamed by
    the result; labels compose. A round works on what is left of the edges, so
    the tables shrink quickly. Self-loops, repeated edges and an empty table
    are fine; rows with a null end are ignored.
    """
    edges = scratch.keep(edges.where("u is not null and v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
    left = edges.where("u < v")
    while not left.isEmpty():
        both = left.select("u", "v").union(left.select("v", "u")).toDF("a", "b")
        hook = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        hook = scratch.keep(hook, "hook")
        for _ in range(2):
            nxt = hook.select(F.col("a").alias("m"), F.col("to").alias("far"))
            hook = hook.join(nxt, F.col("to") == F.col("m"), "left").select("a", F.coalesce("far", "to").alias("to"))
        hook = small(scratch.keep(hook, "hook"))
        labels = scratch.keep(labels.join(hook, F.col("label") == F.col("a"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        h1, h2 = hook.toDF("a1", "to1"), hook.toDF("a2", "to2")
        left = left.join(h1, F.col("u") == F.col("a1"), "left").join(h2, F.col("v") == F.col("a2"), "left").select(F.coalesce("to1", "u").alias("x"), F.coalesce("to2", "v").alias("y"))
        left = scratch.keep(left.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "left")
    return labels
