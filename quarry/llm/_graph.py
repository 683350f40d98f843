"""Connected components of an edge table, by label passing and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node, component for every node of an edge; a
    component is named by its smallest node. Every round is staged, sums up per
    node before it shuffles, and ends when no label changes."""
    own = Scratch(edges.sparkSession)
    both = own.keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    moved = own.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component"), F.lit(True).alias("moved")), "labels")
    while not moved.where("moved").isEmpty():
        labels, last = moved.select("node", "component"), moved
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        passed = labels.join(near, labels["node"] == near["a"]).select("node", F.least("component", "near").alias("new"), F.col("component").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        named = passed.join(jump, "new").select("node", F.least("new", "far").alias("component"), (F.least("new", "far") < F.col("old")).alias("moved"))
        moved = own.keep(named, "labels")
        own.drop(last)
    own.drop(both)
    return moved.select("node", "component")


def joined_components(named: DataFrame, edges: DataFrame) -> DataFrame:
    """named (node, component) after further edges a, b; only components that
    the edges touch are worked on."""
    own = Scratch(named.sparkSession)
    name = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    lifted = edges.join(name("a"), "a", "left").join(name("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    lifted = own.keep(lifted, "edges")
    merged = components(lifted.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    known = named.select("node", "component").union(lifted.select("a", "ca")).union(lifted.select("b", "cb")).distinct()
    new = merged.select(F.col("node").alias("component"), F.col("component").alias("new"))
    out = own.keep(known.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component")), "labels")
    own.drop(lifted)
    return out
