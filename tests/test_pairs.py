"""Joins by file or name whose pairs are many times their rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quarry.operators import callsites, index, lookup


def test_nearest_of_many(spark):
    """Every point and symbol once: no pairs of a file's points with its symbols."""
    symbols = [("a", 10, 1, "x"), ("a", 10, 0, "w"), ("a", 20, 2, "y"), ("b", None, 5, "z"), ("b", None, 4, "v"), ("a", None, 9, "u"), (None, 1, 8, "t")]
    points = [("a", 1), ("a", 10), ("a", 15), ("a", 16), ("a", 99), ("a", None), ("b", 3), ("c", 1), (None, 1), ("a", 1)]
    symbols = spark.createDataFrame(symbols, "file string, line long, id long, name string")
    points = spark.createDataFrame(points, "file string, line int")
    got = lookup.nearest(points, symbols)
    assert got.schema["line"].dataType.simpleString() == "int"
    want = {("a", 1): 0, ("a", 10): 0, ("a", 15): 0, ("a", 16): 2, ("a", 99): 2, ("a", None): 0, ("b", 3): 4}
    assert {(r.file, r.line): r.symbol_id for r in got.collect()} == want and got.count() == len(want)
    many = spark.range(3000).select(F.lit("f").alias("file"), (F.col("id") * 2).alias("line"), "id", F.lit("n").alias("name"))
    asked = many.select("file", (F.col("line") + 1).alias("line"))
    near = lookup.nearest(asked, many)
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.where("symbol_id * 2 = line - 1").count() == 3000


NAMES = [(1, "A.get"), (2, "B.get"), (3, "get"), (4, "B.put"), (5, "put"), (6, "A.b.get"), (7, None), (7, "x.y"), (7, "C.get"), (8, "y"), (8, "y"), (9, "end."), (10, "alone")]
CALLS = [
    (100, 1, "get", "A.get", False), (101, 50, "get", "A.get", True), (102, 4, "put", "get", False), (103, 5, "y", "q.get", None), (104, 2, None, "B.put", False),
    (105, 2, None, None, False), (106, 3, "a.b", "end.", False), (107, 10, "alone", "alone", False), (108, 1, "alone", "m.alone", False), (None, 1, "put", "put", False),
    (109, None, "put", "put", False), (110, 1, "put", "put", False), (110, 2, "put", "y", True), (111, 4, "A.b.get", "none", False), (111, 4, "put", "none", False),
]
EDGES = [(1, 2, "calls"), (1, 3, "calls"), (2, 8, "calls"), (2, 1, "extends"), (4, 7, "calls"), (4, None, "calls"), (9, 1, "calls")]


def candidates():
    """By the pairs: keys against whole names and last parts."""
    last = lambda x: None if x is None else x.split(".")[-1]
    found = set()
    for c, s, callee, target, generic in CALLS:
        keys = {callee, target, last(callee), last(target)} - {None}
        found |= {(c, s, generic, i) for i, n in NAMES if n is not None and {n, last(n)} & keys and None not in (c, s) and i != s}
    n = {c: sum(x[0] == c for x in found) for c, *_ in found}
    return {(c, s, t, (0.35 if g else 1.0) / n[c], t if n[c] == 1 else None) for c, s, g, t in found}


def test_candidates_by_groups(spark, monkeypatch):
    """As by the pairs, with ids of several names, shared call ids, nulls, and several rows of members."""
    calls = spark.createDataFrame(CALLS, "call_id long, source_id long, callee string, target string, generic boolean")
    symbols = spark.createDataFrame(NAMES, "id long, name string")
    edges = spark.createDataFrame(EDGES, "source_id long, target_id long, relationship string")
    want, best = candidates(), {}
    for _, s, t, c, _ in want:
        best[s, t] = max(c, best.get((s, t), 0))
    best = {k: c for k, c in best.items() if (*k, "calls") not in EDGES}
    for most in (4096, 2):
        monkeypatch.setattr(index, "_MEMBERS", most)
        got = [tuple(r) for r in index.callsite_edges(calls, symbols).collect()]
        assert len(got) == len(want) and set(got) == want
        new = callsites.new_edges(index.callsite_groups(calls, symbols), edges, symbols).collect()
        assert len(new) == len(best) and {(r.source_id, r.target_id): r.confidence for r in new} == best


def test_pairs_are_not_dealt(spark):
    """400 call sites of 400 symbols of one name: no exchange, sort or aggregate takes the 159,600 pairs."""
    symbols = spark.range(400).select("id", F.lit("A.run").alias("name"))
    calls = symbols.select(F.col("id").alias("call_id"), F.col("id").alias("source_id"), F.lit("run").alias("callee"), "name", F.lit("A.run").alias("target"), F.lit(False).alias("generic"))
    edges = spark.createDataFrame([(0, 1, "calls")], "source_id long, target_id long, relationship string")
    pairs = index.callsite_edges(calls, symbols)
    new = callsites.new_edges(index.callsite_groups(calls, symbols), edges, symbols)
    assert (pairs.count(), new.count()) == (159_600, 159_599)
    for df in (pairs, new):
        above = df._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        assert re.search("target_id", above) and not re.search("Join|Aggregate|Window|Sort|Repartition", above)


def test_runs_of_pairs(spark, tmp_path, monkeypatch):
    """Call sites follow each other within a run of ids, so a file of pairs takes a small part of a byte for each;
    runs of any length have the same pairs."""
    symbols = spark.range(2000).select("id", F.lit("A.run").alias("name"))
    calls = symbols.select(F.col("id").alias("call_id"), F.col("id").alias("source_id"), F.lit("run").alias("callee"), F.lit("A.run").alias("target"), F.lit(False).alias("generic"))
    index.callsite_edges(calls, symbols).write.parquet(str(tmp_path / "pairs"))
    rows = spark.read.parquet(str(tmp_path / "pairs"))
    assert rows.select("source_id", "target_id").distinct().count() == rows.count() == 2000 * 1999
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * 2000 * 1999
    calls = spark.createDataFrame(CALLS, "call_id long, source_id long, callee string, target string, generic boolean")
    monkeypatch.setattr(index, "_RUN", 3)
    got = [tuple(r) for r in index.callsite_edges(calls, spark.createDataFrame(NAMES, "id long, name string")).collect()]
    assert len(got) == len(candidates()) and set(got) == candidates()


def test_lines_are_dealt_once(spark):
    """Open and resolved edges come from one exchange of the orders' lines."""
    from quarry.plans import registry

    for name in ("callsites_new_edges", "callsites_from_edges"):
        found = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", plan)) == 1, plan
