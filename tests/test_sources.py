from __future__ import annotations

import pytest

from quarry.sources import files, git, parse

TS = """import { fetchProduct as getProduct } from './product';
export abstract class Service extends Base {
  private hooks = 1;
  run(a: string): void {
    this.hooks.make.callAsync(a);
    console.log("x");
    const w = new Widget(1, "two");
  }
}
const {readFile, writeFile: write} = require('fs');
"""


def names(source, file):
    return {(s[0], s[1]) for s in parse.parse(source, file).symbols}


def links(source, file):
    return {e[:3] for e in parse.parse(source, file).edges}


def test_typescript():
    assert {("Service", "class"), ("Service.run", "method"), ("Service.hooks", "variable")} <= names(TS, "src/a.ts")
    e = links(TS, "src/a.ts")
    assert {("Service.run", "this.hooks.make.callAsync", "calls"), ("Service.run", "Widget", "instantiates"), ("Service", "Base", "extends")} <= e
    assert not any("console" in x[1] for x in e)
    got = {(x[1], x[3], x[4]) for x in parse.parse(TS, "src/a.ts").edges if x[2] == "imports"}
    assert got == {("getProduct", "src/product", "fetchProduct"), ("readFile", "fs", "readFile"), ("write", "fs", "writeFile")}


def test_other_languages():
    go = "package m\ntype Service struct { a int }\ntype R interface { Run() }\nfunc (s *Service) Start() error { return nil }\nvar Typed Service\n"
    assert names(go, "m.go") == {("Service", "class"), ("R", "interface"), ("Service.Start", "method"), ("Typed", "variable")}
    java = "public class A implements B {\n  int x = 1;\n  public A(int a) { }\n  class Inner {\n    void nested() { }\n  }\n}\ninterface Child extends Parent { }\n"
    assert {("A", "class"), ("A.x", "variable"), ("A.A", "method"), ("A.Inner", "class"), ("Child", "class")} <= names(java, "A.java")
    assert {("A", "B", "implements"), ("Child", "Parent", "extends")} <= links(java, "A.java")
    rust = "pub enum Mode {\n    Fast,\n}\nimpl<T> Runner for Engine<T> {\n    pub fn search(&self) { helper(); }\n}\nuse crate::foo::{Bar, Baz as Renamed};\n"
    assert {("Mode", "class"), ("Mode.Fast", "variable"), ("Engine.search", "method")} == names(rust, "a.rs")
    assert {("Engine", "Runner", "implements"), ("Engine.search", "helper", "calls"), (None, "Renamed", "imports")} <= links(rust, "a.rs")
    cs = "class Service : Base, IRunner {\n  public string Name { get; set; }\n  public void Run(int x) { helper(x); }\n}\n"
    assert {("Service", "class"), ("Service.Name", "variable"), ("Service.Run", "method")} == names(cs, "a.cs")
    assert {("Service", "Base", "extends"), ("Service", "IRunner", "extends")} <= links(cs, "a.cs")


@pytest.mark.parametrize("source", ["", "// only a comment\n", "class {{{ ((( \0 'x", "/* open"])
def test_broken_sources(source):
    for kind in ("ts", "go", "java", "rs", "cs", "json"):
        assert parse.parse(source, f"f.{kind}").edges == []


def test_signals():
    p = parse.parse('f(process.env.API_URL, "config/app.json");\nconst password = "hunter22 and more";\n', "a.ts")
    assert {(f[0], f[1]) for f in p.facts} == {("environment_variable", "API_URL"), ("config_path", "config/app.json"), ("important_string", "config/app.json")}
    p = parse.parse('{\n"name": "pkg",\n"scripts": {\n"test": "pytest -q"\n}\n}', "package.json")
    assert {("package_name", "pkg"), ("script_name", "test"), ("command", "pytest")} <= {(f[0], f[1]) for f in p.facts}
    p = parse.parse('import x from "lib";\nx.load(1, "a b", true, [2], g(3));\n', "a.ts")
    call = p.callsites[0]
    assert call[1:6] == ("load", "x", "x.load", ["number:1", "string:a b", "boolean:true", "array", "call:g"], ["x->lib"]) and call[7] == 0.95


def test_modules_and_paths():
    known = {"src/product.ts", "src/foo/bar.rs", "src/main/java/com/example/Foo.java"}
    assert parse.resolve_module("typescript", "src/product", known) == "src/product.ts"
    assert parse.resolve_module("rust", "crate::foo::bar", known) == "src/foo/bar.rs"
    assert parse.resolve_module("java", "com.example.Foo", known) == "src/main/java/com/example/Foo.java"
    assert files.resolve_import("src/a/b.ts", "../c") == "src/c"
    assert files.relative("/r/x/../y.ts", "/r") == "y.ts"
    with pytest.raises(ValueError):
        files.relative("../x", "/r")
    assert git.parse_log("---COMMIT---\na.ts\nb.md\n\n---COMMIT---\nc.ts\n", ["ts"]) == [(1, "a.ts"), (2, "c.ts")]


def test_discover_and_parse(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.ts").write_text(TS)
    (tmp_path / "src/b.txt").write_text("no")
    (tmp_path / "node_modules/c.ts").write_text("let x = 1")
    found = files.discover(spark, str(tmp_path)).cache()
    assert [r.file for r in found.collect()] == ["src/a.ts"]
    parsed = parse.parse_files(found)
    assert {r.name for r in parse.table(parsed, "symbols").collect()} >= {"Service", "Service.run"}
    assert parse.table(parsed, "callsites").count() and not parse.table(parsed, "aliases").isEmpty()
    assert files.lines(found).where("line = 1").first().text.startswith("import")
