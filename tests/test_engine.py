from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.functions import scoring, text
from quarry.operators import coupling, fts, graph, index, lines, lookup, search, vector
from quarry.streaming import debounce

SYMBOL = "id long, name string, kind string, file string, line long, end_line long, context string"


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def symbols(spark, rows):
    return spark.createDataFrame([(i, n, k, f, l, l + 4, n) for i, n, k, f, l in rows], SYMBOL)


def edges(spark, rows):
    return spark.createDataFrame(rows, "source_id long, target_id long, relationship string, confidence double")


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        (lambda: scoring.structural(F.lit("calls"), 0.8, F.lit(2)), 0.4),
        (lambda: scoring.semantic(0.25), 0.75),
        (lambda: scoring.evolutionary(5, 0.5), 0.5),
        (lambda: scoring.evolutionary(20, 2.0), 1.0),
        (lambda: scoring.evolutionary(0, 0.0), 0.0),
        (lambda: scoring.fuse(0.8, 0.0, 0.0), 0.45),
        (lambda: scoring.fuse(1.0, 1.0, 1.0), 1.0),
        (lambda: scoring.rrf(0), 1 / 60),
        (lambda: scoring.match_weight(F.lit("exact")), 3.0),
    ],
)
def test_scores(spark, expression, expected):
    assert value(spark, expression()) == pytest.approx(expected)


def test_query_text():
    assert text.sanitise("AND Session.validate") == '"AND" "Session.validate"'
    assert text.sanitise("!!! ---") == ""
    assert text.full_text_match('"two words" x') == "exact_phrase"
    assert text.full_text_match("two words") == "token_match"
    assert text.identifier_terms("getHTTPServer_name2Go") == ["get", "http", "server", "name2", "go"]
    assert text.query_intent("src/a")[0] == "path"
    assert text.query_intent("MAX_SIZE")[:2] == ("symbol", 0.9)  # the last rule that holds names the intent
    assert text.query_intent("how does the session validate a user")[:2] == ("conceptual", 0.7)
    assert text.string_literals("""f("a\\"b", 'c', `d`)""") == ['a\\"b', "c", "d"]
    assert [q for q, _ in text.sub_questions("Q1: what?\nQ2: why?")] == ["Q1", "Q2"]
    assert text.sub_questions("one thing") == [("Q1", "one thing")]
    assert text.repo_paths("see src/a/b.ts and ../x/y.ts") == ["src/a/b.ts"]
    assert text.line_ranges("lines 3-9 and line 20") == [(3, 9), (16, 28)]
    with pytest.raises(ValueError):
        schemas.checked_limit(1001)


def test_lookup(spark):
    s = symbols(spark, [(1, "Foo.bar", "method", "src/a.ts", 1), (2, "_hidden", "function", "src/b.ts", 1), (3, "named", "function", "src/x/feature.ts", 1), (4, "named", "function", "other.ts", 1), (5, "rebar", "class", "src/a.ts", 9)])
    assert [(r.id, r.match) for r in lookup.list_symbols(s, "bar", 10).collect()] == [(1, 1), (5, 2)]
    assert lookup.list_symbols(s, "100%", 10).isEmpty()
    asked = spark.createDataFrame([("named", "feature.ts"), ("bar", None), ("hidden", None)], "wanted string, in_file string")
    assert {(r.wanted, r.id) for r in lookup.fuzzy(s, asked).collect()} == {("named", 3), ("bar", 1), ("hidden", 2)}
    assert lookup.list_relaxed(s, "named", 5, "method").first().relaxed
    wide = spark.createDataFrame([(1, "C", "class", "f", 1, 9, ""), (2, "C.m", "method", "f", 2, 4, "")], SYMBOL)
    points = spark.createDataFrame([("f", 3), ("f", 8), ("f", 40)], "file string, line long")
    got = {(r.line, r.symbol_id, r.contained) for r in lookup.anchors(points, wide).collect()}
    assert got == {(3, 2, True), (8, 1, True), (40, 2, False)}


def test_lines(spark):
    rows = spark.createDataFrame([("src/a.ts", 1, "open the Session now"), ("src/a.ts", 2, "session of validate"), ("t/test.ts", 3, "session validate")], "file string, line long, text string")
    assert [(r.line, r.match) for r in lines.ranked_scan(rows, "session validate", 9).collect()] == [(3, "exact_phrase"), (2, "ordered_tokens")]
    spans = spark.createDataFrame([("src/a.ts", 1, 2)], "file string, first long, last long")
    cut = lines.snippet(rows, spans, 25).first()
    assert cut.text == "open the Session now\nsess" and cut.truncated
    assert lines.scan(rows, "ab").isEmpty()


def test_full_text(spark):
    d = spark.createDataFrame([(1, "Session.validate", "checks a session"), (2, "logical_gate", "and or"), (3, "quote", "the exact phrase here")], "id long, name string, context string")
    assert [r.id for r in fts.bm25(d, "id", ["name", "context"], "session").collect()] == [1]
    assert fts.bm25(d, "id", ["name", "context"], '"exact phrase"').first().field == "context"
    assert fts.bm25(d, "id", ["name", "context"], '"phrase exact"').isEmpty()
    assert fts.bm25(d, "id", ["name", "context"], "session gate").isEmpty()
    assert fts.bm25(d, "id", ["name", "context"], "!!").isEmpty()


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, [0.0, 0.0])], "symbol_id long, embedding array<float>")
    assert [(r.id, r.distance) for r in vector.knn(v, [0.0, 0.0], 3).collect()] == [(1, 0.0), (3, 0.0), (2, 5.0)]
    assert vector.knn(v, [0.0, 0.0], 0).isEmpty()
    with pytest.raises(Exception, match="another dimension"):
        vector.knn(v, [0.0], 1).collect()
    t = spark.createDataFrame([(1, "validateSession user"), (2, "")], "id long, context string")
    got = {r.id: r.embedding for r in vector.hashing_embed(t, "id", "context", 16).collect()}
    assert sum(x * x for x in got[1]) == pytest.approx(1) and not any(got[2])


def test_graph(spark):
    g = graph.build(edges(spark, [(1, 2, "calls", 0.3), (1, 2, "imports", 0.9), (3, 1, "calls", 0.8), (3, None, "calls", 0.0)]))
    assert g.count() == 2
    one = lambda x: spark.createDataFrame([(x,)], "source long")
    assert [(r.id, r.confidence) for r in graph.bfs(g, one(1), 1).collect()] == [(2, 0.9)]
    assert graph.shortest_path(g, 3, 2) == [3, 1, 2] and graph.shortest_path(g, 2, 3) is None
    assert sorted((r.id, round(r.impact, 6)) for r in graph.impact_radius(g, 2, 2).collect()) == [(1, 0.9), (3, 0.4)]
    assert graph.centrality(g, 1).first().id == 1
    assert graph.bfs(g, one(1), 0).isEmpty() and graph.bfs(g, one(99), 3).isEmpty()
    chain = edges(spark, [(k, k + 1, "calls", 1.0) for k in range(1, 5)])
    s = symbols(spark, [(k, "ABCDE"[k - 1], "function", "f", k) for k in range(1, 6)])
    assert [r.name for r in search.graph_mode(s, graph.build(chain), 3, "callers", 9).collect()] == ["B", "A"]
    assert [r.name for r in search.graph_mode(s, graph.build(chain), 3, "impact", 9).collect()] == ["D", "E"]


def test_cochange_and_coupling(spark):
    commits = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a")]
    got = {(r.file_a, r.file_b): (r.frequency, round(r.recency, 4)) for r in coupling.cochange(spark.createDataFrame(commits, "idx long, file string")).collect()}
    assert got[("a", "b")] == (2, round(1 / 2 + 1 / 3, 4)) and len(got) == 3
    shape = "file_a string, file_b string, frequency long, recency double"
    pairs = coupling.upsert(spark.createDataFrame([("b", "a", 2, 0.1), ("a", "c", 4, 0.1)], shape), spark.createDataFrame([("a", "b", 7, 0.1)], shape))
    assert pairs.count() == 2 and coupling.top_partners(pairs, "a", 1).first()[:2] == ("b", 7)
    s = symbols(spark, [(1, "a", "function", "f1", 1), (2, "b", "function", "f2", 1), (3, "c", "function", "f1", 9)])
    e = spark.createDataFrame([(2, None, "a", "calls", 0.0)], "source_id long, target_id long, target_name string, relationship string, confidence double")
    g = graph.build(e)
    assert coupling.impact(s, e, g, pairs, 1).first()[:] == (2, 0.8, "unresolved_name_edge")
    near = spark.createDataFrame([(2, 0.2)], "id long, distance double")
    rows = coupling.coupled(s, g, pairs, near, 1)
    assert [(r.id, round(r.semantic, 2)) for r in rows.collect()] == [(2, 0.8)]
    assert {(r.id, r.why) for r in coupling.neighbourhood(rows, s, 1).collect()} == {(2, "coupled"), (3, "co_located")}


def test_index(spark):
    s = symbols(spark, [(1, "fetch", "function", "lib.ts", 1), (2, "Store.load", "method", "lib.ts", 9), (3, "Page.show", "method", "page.ts", 1), (4, "Page.hide", "method", "page.ts", 9), (5, "dup", "function", "a.ts", 1), (6, "dup", "function", "b.ts", 1)])
    e = [(1, "page.ts", "Page.show", "fetchIt", None), (2, "page.ts", "Page.show", "this.hide", None), (3, "x.ts", "x", "Store.load", None), (4, "x.ts", "x", "load", None), (5, "x.ts", "x", "dup", None), (6, "x.ts", "x", "dup", "b.ts")]
    imports = [("page.ts", "fetchIt", "lib.ts", "fetch")]
    got = index.resolve_edges(spark.createDataFrame(e, "edge_id long, source_file string, source_name string, target_name string, target_file string"), s, spark.createDataFrame(imports, "source_file string, local_name string, resolved_file string, original string"))
    assert {r.edge_id: (r.target_id, r.confidence) for r in got.collect()} == {1: (1, 0.95), 2: (4, 0.95), 3: (2, 1.0), 4: (2, 0.8), 5: (None, 0.0), 6: (6, 1.0)}
    left = index.unlink(edges(spark, [(1, 2, "calls", 0.9), (2, 1, "calls", 0.9)]), spark.createDataFrame([(2,)], "id long"))
    assert [(r.source_id, r.target_id, r.confidence) for r in left.collect()] == [(1, None, 0.0)]
    rows = spark.createDataFrame([("f", "env", "A", "x", 5, 5), ("f", "env", "A", "x", 2, 7)], "file string, fact_type string, value string, enclosing string, line long, end_line long")
    assert index.materialise_facts(rows).first()[4:] == (2, 7, 2)
    assert index.revision(s).first() == index.revision(s.repartition(3)).first()


def test_search(spark):
    s = symbols(spark, [(1, "needle", "function", "a.ts", 1), (2, "semantic_helper", "function", "b.ts", 1), (3, "graphOnly", "function", "c.ts", 1), *((k, f"x{k}", "function", "z.ts", k) for k in range(10, 30))])
    g = graph.build(edges(spark, [(1, 3, "calls", 0.9)]))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), *((k, [0.0, 1.0]) for k in range(10, 30))], "id long, embedding array<float>")
    hits = [r.asDict() for r in search.search(s, g, "needle", 10, vectors=v, embedded=[1.0, 0.0]).collect()]
    exact = [h for h in hits if h["bucket"] == "exact"]
    assert [h["name"] for h in exact] == ["needle"] and "exact:name" in exact[0]["reasons"] and "semantic" in exact[0]["reasons"]
    beyond = [h["name"] for h in hits if h["bucket"] == "beyond"]
    assert len(beyond) == 3 and {"semantic_helper", "graphOnly"} <= set(beyond)
    small = search.envelope("needle", hits, tokens=150)
    assert small["truncated"] and small["returned_tokens"] <= 150


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:00.0", "a"), ("2024-01-01 00:00:00.3", "a"), ("2024-01-01 00:00:02", "a"), ("2024-01-01 00:00:00", "b")], "ts string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.path, r.events) for r in debounce.sessions(events, "500 milliseconds").collect()) == [("a", 1), ("a", 2), ("b", 1)]
    rows = [("p", "create", "h1"), ("p", "modify", "h1"), ("p", "modify", "h2"), ("p", "remove", None), ("p", "modify", "h2")]
    spark.createDataFrame(rows, "path string, kind string, hash string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, kind string, hash string").parquet(str(tmp_path / "in"))
    seen = []
    debounce.refresh(debounce.changed_stream(stream), str(tmp_path / "cp"), lambda d, k: seen.extend(r.path for r in d.collect())).awaitTermination()
    assert seen == ["p"]


def test_inspect_and_evidence(spark):
    from quarry.operators import evidence

    s = symbols(spark, [(1, "Font.load", "method", "src/font.ts", 2), (2, "Other.skip", "method", "src/o.ts", 1)])
    src = spark.createDataFrame([("src/font.ts", k, f"line {k}") for k in range(1, 12)], "file string, line long, text string")
    tables = {"symbols": s, "lines": src}
    one = evidence.inspect("symbol:1@idx-a", tables, max_lines=2, revision="idx-b")
    assert (one["start_line"], one["end_line"], one["next_offset"], one["warning"]) == (2, 3, 2, "handle of another revision")
    two = evidence.inspect("symbol:1", tables, offset=2, max_lines=9)
    assert (two["start_line"], two["end_line"], two["next_offset"]) == (4, 6, None)
    whole = evidence.inspect("file:" + b"src/font.ts".hex(), tables, max_lines=3)
    assert whole["text"] == "line 1\nline 2\nline 3" and whole["next_offset"] == 3
    for bad in ("x:1", "symbol:", "symbol:a", "file:zz", "file:" + b"../x".hex()):
        with pytest.raises(ValueError):
            evidence.inspect(bad, tables)
    g = graph.build(edges(spark, [(1, 2, "calls", 0.9)]))
    found = evidence.pack("How does `Font.load` work?", s, g, src)
    assert found["answers"][0]["hits"][0]["name"] == "Font.load" and found["slices"] and found["coverage"]["answered"] == 1
    assert len(evidence.batch(["Font", {"query": "skip", "limit": 2}], s, g)) == 2
