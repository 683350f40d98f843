"""Change co-occurrence and coupling between symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import scoring
from quarry.operators import graph as g


def cochange(commits: DataFrame, most_files: int = schemas.MAX_FILES_PER_COMMIT) -> DataFrame:
    """commits: idx, file. Pairs of files (file_a < file_b) with how often they
    changed together and how recently. Commits of one file or too many are left out
    before the pairs are made, so a commit gives a bounded number of them."""
    files = commits.select("idx", "file").distinct()
    sized = files.groupBy("idx").agg(F.collect_set("file").alias("files")).where(F.size("files").between(2, most_files))
    a = sized.select("idx", "files", F.explode("files").alias("file_a"))
    pairs = a.select("idx", "file_a", F.explode(F.filter("files", lambda f: f > F.col("file_a"))).alias("file_b"))
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("frequency"), F.least(F.sum(1.0 / (1 + F.col("idx"))), F.lit(1.0)).alias("recency"))


def upsert(pairs: DataFrame, updates: DataFrame) -> DataFrame:
    """pairs with the rows of updates in place of theirs; either order of the two files."""
    canon = lambda d: d.select(F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b"), "frequency", "recency")
    new = canon(updates)
    return canon(pairs).join(new, ["file_a", "file_b"], "left_anti").unionByName(new)


def top_partners(pairs: DataFrame, file: str, limit: int) -> DataFrame:
    both = pairs.select(F.col("file_a").alias("file"), F.col("file_b").alias("other"), "frequency", "recency").union(pairs.select("file_b", "file_a", "frequency", "recency"))
    return both.where(F.col("file") == file).orderBy(F.desc("frequency"), F.desc("recency"), "other").limit(limit).select("other", "frequency", "recency")


def with_evolution(rows: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """rows with evolutionary, from the pair of the files in columns a and b; 0 without one."""
    rows = rows.withColumn("file_a", F.least(a, b)).withColumn("file_b", F.greatest(a, b))
    met = rows.join(pairs, ["file_a", "file_b"], "left")
    return met.withColumn("evolutionary", F.coalesce(scoring.evolutionary("frequency", "recency"), F.lit(0.0))).drop("file_a", "file_b", "frequency", "recency")


def coupled(symbols: DataFrame, graph: DataFrame, pairs: DataFrame, nearby: DataFrame, target: int, *, threshold: float = schemas.COUPLING_THRESHOLD, cap: int = schemas.STRUCTURAL_CAP) -> DataFrame:
    """id, structural, semantic, evolutionary, combined of what is coupled with target.

    Neighbours within two steps in either direction count if their fused score
    reaches the threshold, the cap best at most; nearby (id, distance) adds the
    semantic signal, and symbols of its own, but not neighbours that were rejected."""
    one = graph.sparkSession.createDataFrame([(target,)], "source long")
    both = graph.select("source_id", "target_id", "relationship", "confidence").union(graph.select("target_id", "source_id", "relationship", "confidence"))
    reach = g.bfs(both, one, 2).where(F.col("id") != target)
    place = symbols.select("id", "file")
    home = place.where(F.col("id") == target).select(F.col("file").alias("home"))
    near = with_evolution(reach.join(place, "id").join(F.broadcast(home)), pairs, "file", "home")  # one row
    near = near.withColumn("structural", scoring.structural("relationship", "confidence", "depth")).withColumn("first", scoring.fuse("structural", 0.0, "evolutionary"))
    strong = near.where(F.col("first") >= threshold).orderBy(F.desc("confidence"), "depth", "id").limit(cap).select("id", "structural", F.lit(True).alias("kept"))
    seen = near.select("id", F.lit(True).alias("seen"))
    close = nearby.where(F.col("id") != target).select("id", scoring.semantic("distance").alias("semantic")).where(F.col("semantic") > threshold)
    rows = strong.join(close, "id", "full").join(seen, "id", "left").where("kept or seen is null")
    rows = with_evolution(rows.join(place, "id").join(F.broadcast(home)), pairs, "file", "home")
    rows = rows.select("id", F.coalesce("structural", F.lit(0.0)).alias("structural"), F.coalesce("semantic", F.lit(0.0)).alias("semantic"), "evolutionary")
    return rows.withColumn("combined", scoring.fuse("structural", "semantic", "evolutionary"))


def neighbourhood(coupled_rows: DataFrame, symbols: DataFrame, target: int, limit: int = schemas.EXPANSION_LIMIT) -> DataFrame:
    """Coupled symbols, and at 0.4 those of the target's file that are not."""
    home = symbols.where(F.col("id") == target).select("file")
    beside = symbols.join(F.broadcast(home), "file", "left_semi").where(F.col("id") != target).join(coupled_rows, "id", "left_anti")
    rows = coupled_rows.select("id", F.col("combined").alias("score"), F.lit("coupled").alias("why")).union(beside.select("id", F.lit(0.4), F.lit("co_located")))
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def impact(symbols: DataFrame, edges: DataFrame, graph: DataFrame, pairs: DataFrame, target: int, limit: int = schemas.EXPANSION_LIMIT) -> DataFrame:
    """Dependents within three steps by fused score; direct and unresolved name edges at 0.8; the first source of a symbol counts."""
    place = symbols.select("id", "file")
    one = symbols.where(F.col("id") == target).select(F.col("name").alias("wanted"), F.col("file").alias("home"))
    rows = g.bfs(graph, graph.sparkSession.createDataFrame([(target,)], "source long"), 3, reverse=True)
    rows = with_evolution(rows.join(place, "id").join(F.broadcast(one)), pairs, "file", "home")
    first = rows.select("id", scoring.fuse(scoring.structural("relationship", "confidence", "depth"), 0.0, "evolutionary").alias("score"), F.lit(0).alias("source"))
    direct = edges.where(F.col("target_id") == target).select(F.col("source_id").alias("id"), F.lit(0.8).alias("score"), F.lit(1).alias("source"))
    named = edges.where("target_id is null").join(F.broadcast(one), F.col("target_name") == F.col("wanted")).select(F.col("source_id").alias("id"), F.lit(0.8).alias("score"), F.lit(2).alias("source"))
    every = first.union(direct).union(named).where(F.col("id") != target)
    best = every.groupBy("id").agg(F.min_by(F.struct("score", "source"), F.struct("source", (-F.col("score")).alias("s"))).alias("b"))
    provenance = F.when(F.col("b.source") == 0, "graph").when(F.col("b.source") == 1, "resolved_edge").otherwise("unresolved_name_edge")
    return best.select("id", F.col("b.score").alias("score"), provenance.alias("provenance")).orderBy(F.desc("score"), "id").limit(limit)
