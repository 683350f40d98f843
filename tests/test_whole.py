"""Whole results by brute force, where a registered twin covers only a part."""

from __future__ import annotations

import duckdb

from quarry.operators import graph
from quarry.plans import registry

DIR = "/root/testdata/sf0.001"


def test_all_callsites(spark):
    symbols = duckdb.sql(f"select p_partkey, replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') from '{DIR}/part.parquet'").fetchall()
    last = {i: n.split(".")[-1] for i, n in symbols}
    want = {}
    for i, n in symbols:
        asked = {n, last[i]}
        found = [j for j, m in symbols if j != i and asked & {m, last[j]}]
        for j in found:
            want[i, j] = (round((0.35 if i % 4 == 0 else 1.0) / len(found), 6), j if len(found) == 1 else None)
    got = registry.QUERIES["callsite_candidates"](spark, DIR).collect()
    assert len(got) == len(want)
    assert {(r.call_id, r.target_id): (r.confidence, r.resolved_id) for r in got} == want
    assert any(r.call_id % 25 for r in got)


def test_paths_without_bound(spark):
    shape = "source_id long, target_id long, relationship string, confidence double"
    chain = graph.build(spark.createDataFrame([(k, k + 1, "calls", 1.0) for k in range(17)], shape))
    assert graph.shortest_path(chain, 0, 17) == list(range(18))
    ring = graph.build(spark.createDataFrame([(k, (k + 1) % 5, "calls", 1.0) for k in range(5)] + [(50, 51, "calls", 1.0)], shape))
    assert graph.shortest_path(ring, 0, 51) is None
    one = spark.createDataFrame([(2,)], "source long")
    assert {r.id: r.depth for r in graph.reached(ring, one, reverse=True).collect()} == {1: 1, 0: 2, 4: 3, 3: 4}


def test_all_path_lengths(spark):
    lines = duckdb.sql(f"select l_partkey, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity), l_linestatus from '{DIR}/lineitem.parquet'").fetchall()
    out = {}
    for a, b, s in lines:
        if b is not None and a != b and s == "F":
            out.setdefault(a, set()).add(b)
    want, level, depth = {registry.TARGET: 0}, {registry.TARGET}, 0
    while level:
        depth += 1
        level = {b for a in level for b in out.get(a, ())} - want.keys()
        want |= dict.fromkeys(level, depth)
    del want[registry.TARGET]
    got = registry.QUERIES["shortest_path_len"](spark, DIR).collect()
    assert len(got) == len(want) and {r.id: r.depth for r in got} == want


def test_cards_of_a_tree(spark, tmp_path):
    from quarry.plans.engine import Engine

    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src/page.ts").write_text("import { helper as h } from './lib';\nexport class Page {\n  run() {\n    h(1);\n  }\n}\n")
    (root / "src/lib.ts").write_text("export function helper(x) {\n  return x + 1;\n}\n")
    (root / "src/lib.spec.ts").write_text("import { helper } from './lib';\nexport function check() {\n  return helper(1);\n}\n")
    e = Engine(spark, str(root), str(tmp_path / "store"))
    e.reindex(history=False)
    cards = {r.file: r for r in e.store.read("role_cards").collect()}
    assert {f: r.tests for f, r in cards.items()} == {"src/page.ts": [], "src/lib.ts": ["src/lib.spec.ts"], "src/lib.spec.ts": []}
    assert cards["src/lib.ts"].imported == [] and cards["src/page.ts"].imported and cards["src/page.ts"].imported == cards["src/lib.spec.ts"].imported
    assert all("lib" in x for x in cards["src/page.ts"].imported), cards["src/page.ts"].imported
