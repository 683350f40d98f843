from __future__ import annotations

from quarry.__main__ import parser
from quarry.plans.engine import Engine

A = "import { helper as h } from './lib';\nexport class Service {\n  run() {\n    h(1);\n    this.stop();\n  }\n  stop() {\n    return process.env.API_URL;\n  }\n}\n"
B = "export function helper(x) {\n  return x + 1;\n}\n"


def test_refresh_and_ask(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src/service.ts").write_text(A)
    (root / "src/lib.ts").write_text(B)
    e = Engine(spark, str(root), str(tmp_path / "store"))
    assert e.reindex(history=False) == {"files_new": 2, "files_changed": 0, "files_deleted": 0, "errors": 0}
    names = {s["name"]: s["handle"] for s in e.symbols("s", 50) + e.symbols("helper")}
    assert {"Service", "Service.run", "Service.stop", "helper"} <= set(names)
    links = {(r.target_name, r.confidence) for r in e.store.read("edges").where("target_id is not null and relationship = 'calls'").collect()}
    assert links == {("h", 0.95), ("this.stop", 0.95)}
    calls = {(r.file, r.line): r.resolved_id for r in e.store.read("callsites").collect()}
    ids = {r.name: r.id for r in e.store.read("symbols").collect()}
    assert calls["src/service.ts", 4] == ids["helper"] and calls["src/service.ts", 5] == ids["Service.stop"], calls
    assert "fact:environment_variable" in e.search("API_URL")["exact_hits"][0]["reasons"]
    assert e.search("return x + 1")["exact_hits"][0]["name"] == "helper"  # only a line says so
    assert {x["name"] for x in e.impact("helper")} == {"Service.run", "Service"}  # the import belongs to the first symbol
    assert e.inspect(names["helper"])["text"].startswith("export function helper")
    assert e.search("helper")["exact_hits"][0]["name"] == "helper"
    assert e.search("helper", mode="callers")["exact_hits"][0]["name"] == "Service.run"
    assert "helper" in {x["name"] for x in e.neighborhood("src/service.ts", 4)}
    assert e.status()["stale"] == 0
    (root / "src/lib.ts").write_text(B.replace("helper", "renamed"))
    assert e.status()["stale"] == 1
    assert e.reindex(history=False)["files_changed"] == 1
    assert e.symbols("helper") == [] and e.store.read("index_meta").count() == 2
    assert not {r.target_name for r in e.store.read("edges").where("target_id is not null").collect()} & {"h"}
    (root / "src/service.ts").unlink()
    assert e.reindex(history=False)["files_deleted"] == 1 and e.store.read("symbols").count() == 1


def test_command_line():
    o = parser().parse_args(["search", "x", "--limit", "3"])
    assert (o.command, o.query, o.limit, o.mode) == ("search", "x", 3, "auto")
    assert parser().parse_args(["inspect", "symbol:1"]).max_lines == 24
