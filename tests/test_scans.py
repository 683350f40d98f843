"""Search channels, call-site passes, ranking and settings on small tables."""

from __future__ import annotations

import pytest

from quarry.config import Config, ConfigError
from quarry.operators import callsites, ranking, scans, search

SYMBOLS = [(1, "Box", "class", "a.ts", 1, 20), (2, "Box.open", "method", "a.ts", 3, 6), (3, "Lid.open", "method", "b.ts", 1, 4), (4, "shut", "function", "b.ts", 6, 9)]


@pytest.fixture(scope="module")
def symbols(spark):
    return spark.createDataFrame([(*s, s[1]) for s in SYMBOLS], "id long, name string, kind string, file string, line long, end_line long, context string")


def test_line_symbols(spark, symbols):
    hits = spark.createDataFrame([("a.ts", 4), ("a.ts", 30), ("notes.txt", 2)], "file string, line long")
    got = {(r.file, r.line): (r.name, r.kind, r.id) for r in search.line_symbols(hits, symbols).collect()}
    assert got[("a.ts", 4)] == ("Box.open", "method", 2) and ("a.ts", 30) not in got
    assert got[("notes.txt", 2)][:2] == ("notes.txt", "file_match") and got[("notes.txt", 2)][2] < 0


def test_gate():
    assert search.wants_lines("ab.c", 100, 10) and search.wants_lines("abc", 3, 10)
    assert not search.wants_lines("abc", 100, 10) and not search.wants_lines("ab", 0, 10) and not search.wants_lines("abc", 0, 0)
    assert search.wants_lines("open the box", 100, 10)
    assert (search.line_limit("abc", 1), search.line_limit("one two three", 20), search.line_limit("abc", 100)) == (32, 320, 512)


def test_receiver_types(symbols):
    assert [(r.id, r.score) for r in search.receiver_types(symbols, symbols).collect()] == [(1, 2.5)]


def test_search_finds_facts_and_lines(spark, symbols):
    graph = spark.createDataFrame([], "source_id long, target_id long, relationship string, confidence double")
    facts = spark.createDataFrame([(1, "env", "HOME", "a.ts", 4, 2), (2, "env", "HOME", "z.ts", 1, None)], "id long, fact_type string, value string, file string, line long, symbol_id long")
    lines = spark.createDataFrame([("b.ts", 7, "return warm_up()"), ("notes.txt", 1, "warm_up() first")], "file string, line long, text string")
    assert [r.name for r in search.search(symbols, graph, "HOME", 5, facts=facts).collect()] == ["Box.open"]
    assert {r.name for r in search.search(symbols, graph, "warm_up", 5, lines=lines).collect()} == {"shut", "notes.txt"}
    assert search.search(symbols, graph, "warm_up", 5).count() == 0


def test_call_passes(spark, symbols):
    calls = spark.createDataFrame(
        [(10, "a.ts", 4, "open", "Lid.open", False, "Box.open"), (11, "a.ts", 5, "shut", "shut", False, "Box.open"), (12, "b.ts", 2, "open", "x.open", True, "shut"), (13, "b.ts", 2, "shut", "shut", False, None)],
        "id long, file string, line long, callee string, target string, generic boolean, enclosing string",
    ).selectExpr("*", "cast(null as long) as resolved_id")
    edges = spark.createDataFrame([(1, 2, 3, "Lid.open", None, "calls", 0.8, None)], "id long, source_id long, target_id long, target_name string, target_file string, relationship string, confidence double, original_name string")
    got, added = callsites.resolve(calls, edges, symbols)
    assert {r.id: r.resolved_id for r in got.collect()} == {10: 3, 11: 4, 12: 2, 13: None}  # 12: the added edges, the smaller id of equals
    new = {(r.source_id, r.target_id, r.confidence) for r in added.collect()}
    assert new == {(2, 4, 1.0), (4, 2, 0.175), (4, 3, 0.175)}


def test_scans(spark, symbols):
    assert [(r.id, r.truncated) for r in scans.page(symbols, ["id"], 2).collect()] == [(1, True), (2, True)]
    assert [r.truncated for r in scans.page(symbols, ["id"], 4).collect()] == [False] * 4 and scans.page(symbols, ["id"], 0).count() == 0
    assert scans.continuation("symbols", False, 2, 0) is None and scans.continuation("symbols", True, 2, 3)["cursor"] == "symbols:offset:2"
    assert [r.id for r in scans.method_suffix(symbols, "OPEN").collect()] == [2, 3] and [r.id for r in scans.method_suffix(symbols, "open", "b.ts").collect()] == [3]
    lines = spark.createDataFrame([("a", 1, "xy")], "file string, line long, text string")
    assert [scans.line_contains(lines, "a", n, "y").first().found for n in (1, 2)] == [True, False]


def test_ranking(spark):
    assert ranking.evidence_terms("Where does the Engine lock the cache?") == ["cache", "engine", "lock"]
    lines = spark.createDataFrame([("a.go", 1, "m.Lock()"), ("a.go", 2, "type Cache struct"), ("a_test.go", 3, "cache"), ("a.go", 4, "")], "file string, line long, text string")
    assert [(r.line, r.points) for r in ranking.ranked_lines(lines, ["cache", "lock"]).orderBy("line").collect()] == [(1, 6), (2, 3), (3, 1)]
    assert [(r.line, r.points) for r in ranking.ranked_matches(lines, ["cache"], "which struct").collect()] == [(2, 13), (1, 1), (4, 1), (3, 0)]
    items = {c["item"]: c["status"] for c in ranking.coverage([{}], [{"reasons": "graph:calls"}], [], [], [])}
    assert items["exact_matches"] == items["graph_neighbors"] == "included" and items["source_snippets"] == "missing"
    assert len(ranking.missing("q", [], [])) == 2 and ranking.missing("q", [1], []) == []


def test_config(tmp_path):
    assert Config.load(str(tmp_path)).weights["structural"] == 0.45
    (tmp_path / ".quarry").mkdir()
    path = tmp_path / ".quarry/config.toml"
    path.write_text("semantic_weight = 0.5\nwatch_extensions = ['.py']\n")
    c = Config.load(str(tmp_path))
    assert (c.semantic_weight, c.watch_extensions, c.structural_weight) == (0.5, (".py",), 0.45)
    for bad in ("structural_weight = -1.0", "structural_weight = nan", "structural_weight = 0.0\nsemantic_weight = 0.0\nevolutionary_weight = 0.0", "coupling_threshold = 2.0", "embedding_dimensions = 0", "store = '/x'", "store = '../x'", "store = ''", "nonsense = 1", "= 1"):
        path.write_text(bad)
        with pytest.raises(ConfigError):
            Config.load(str(tmp_path))
