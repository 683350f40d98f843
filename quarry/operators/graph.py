"""The relationship graph: one edge per pair, bounded searches, centrality, roles."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(edges: DataFrame) -> DataFrame:
    """Of resolved edges the best per ordered pair: highest confidence, then the first relationship by name."""
    own = F.min(F.struct((-F.col("confidence")).alias("c"), "relationship"))
    return edges.where("target_id is not null").groupBy("source_id", "target_id").agg(own.alias("e")).select("source_id", "target_id", "e.relationship", (-F.col("e.c")).alias("confidence"))


def _steps(graph: DataFrame, reverse: bool) -> DataFrame:
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    return graph.select(F.col(a).alias("via"), F.col(b).alias("id"), "relationship", "confidence")


def _level(steps: DataFrame, frontier: DataFrame, seen: DataFrame, level: int) -> DataFrame:
    reach = frontier.select("source", F.col("id").alias("via")).join(steps, "via").join(seen, ["source", "id"], "left_anti")
    best = F.min_by(F.struct("relationship", "confidence", "via"), F.struct((-F.col("confidence")).alias("c"), "relationship", "via"))
    return reach.groupBy("source", "id").agg(best.alias("e")).select("source", "id", F.lit(level).alias("depth"), "e.relationship", "e.confidence", "e.via")


def bfs(graph: DataFrame, sources: DataFrame, depth: int, *, reverse: bool = False) -> DataFrame:
    """sources: source. source, id, depth, relationship, confidence, via of every
    node within depth steps (against the edges if reverse). A node is reached at its
    smallest depth by the edge of highest confidence, then relationship, then neighbour.
    Each level is one join of the frontier and drops what was seen."""
    steps = _steps(graph, reverse)
    seen = sources.select("source", F.col("source").alias("id")).distinct()
    frontier, levels = seen, []
    for level in range(1, depth + 1):
        found = _level(steps, frontier, seen, level)
        levels.append(found)
        frontier = found.select("source", "id")
        seen = seen.union(frontier)
    if not levels:
        return seen.limit(0).select("source", "id", F.lit(0).alias("depth"), F.lit("").alias("relationship"), F.lit(0.0).alias("confidence"), F.col("id").alias("via"))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out


def _kept(df: DataFrame) -> DataFrame:
    """df computed once and its lineage cut, in spark.checkpoint.dir; only a local master has a default for it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(f"file:///tmp/checkpoints/{os.getuid()}")
    return df.checkpoint()


def reached(graph: DataFrame, sources: DataFrame, *, reverse: bool = False, until: int | None = None) -> DataFrame:
    """bfs without a bound: it ends when a level reaches no new node, or with the level
    that reaches until. Every level is kept, and what was seen is dealt anew every 16 levels."""
    steps = _kept(_steps(graph, reverse))
    frontier = _kept(sources.select("source", F.col("source").alias("id")).distinct())
    edge = [F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in ("relationship", "confidence", "via")]
    out = frontier.select("source", "id", F.lit(0).alias("depth"), *edge)
    level = 0
    while True:
        level += 1
        found = _kept(_level(steps, frontier, out.select("source", "id"), level))
        hit = found if until is None else found.where(F.col("id") == until)
        out = out.union(found)
        if found.isEmpty() or (until is not None and not hit.isEmpty()):
            return out.where("depth > 0")
        if level % 16 == 0:
            out = _kept(out.repartition("source", "id"))
        frontier = found.select("source", "id")


def neighbours(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes: node. Best edge per neighbour over both directions; an incoming one wins ties."""
    into = graph.select(F.col("target_id").alias("node"), F.col("source_id").alias("id"), "relationship", "confidence", F.lit(0).alias("side"))
    out = graph.select(F.col("source_id").alias("node"), F.col("target_id").alias("id"), "relationship", "confidence", F.lit(1).alias("side"))
    both = into.union(out).join(nodes.distinct(), "node", "left_semi")
    best = F.min_by(F.struct("relationship", "confidence", "side"), F.struct((-F.col("confidence")).alias("c"), "side", "relationship"))
    return both.groupBy("node", "id").agg(best.alias("e")).select("node", "id", "e.relationship", "e.confidence", F.when(F.col("e.side") == 0, "incoming").otherwise("outgoing").alias("direction"))


def shortest_path(graph: DataFrame, source: int, target: int, most: int | None = None) -> list[int] | None:
    """Nodes from source to target with the fewest steps, of most steps if it is given; None
    where no path leads there. Of equal ones the edges are as in bfs."""
    if source == target:
        return [source]
    rows = graph.sparkSession.createDataFrame([(source,)], "source long")
    found = (reached(graph, rows, until=target) if most is None else bfs(graph, rows, most)).select("id", "depth", "via")
    path, at = [target], target
    while at != source:
        step = found.where(F.col("id") == at).first()
        if step is None:
            return None
        at = step["via"]
        path.append(at)
    return path[::-1]


def centrality(graph: DataFrame, top: int | None = None) -> DataFrame:
    """Distinct other nodes that point to a node, over the number of other nodes."""
    nodes = graph.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    n = nodes.agg((F.count("*") - 1).alias("others"))
    ins = graph.where("source_id <> target_id").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("inbound"))
    rows = nodes.join(ins, "id", "left").join(F.broadcast(n), how="inner")  # one row
    rows = rows.select("id", F.coalesce(F.col("inbound") / F.greatest("others", F.lit(1)), F.lit(0.0)).alias("centrality"))
    return rows if top is None else rows.orderBy(F.desc("centrality"), "id").limit(top)


def impact_radius(graph: DataFrame, node: int, depth: int) -> DataFrame:
    """Dependents by confidence, halved for each level beyond the first."""
    rows = bfs(graph, graph.sparkSession.createDataFrame([(node,)], "source long"), depth, reverse=True)
    return rows.select("id", "depth", (F.col("confidence") / F.pow(F.lit(2.0), F.col("depth") - 1)).alias("impact"))


# What a relationship makes of a neighbour, by direction.
_OUT = {"calls": "callee", "imports": "imported", "implements": "interface", "extends": "base_type"}
_IN = {"calls": "caller", "imports": "import", "implements": "implementor", "extends": "subtype"}


def role(relationship: str = "relationship", outgoing: bool = True):
    table = _OUT if outgoing else _IN
    out = F.col(relationship)
    for k, v in table.items():
        out = F.when(F.col(relationship) == k, v).otherwise(out)
    return out
