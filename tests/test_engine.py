import json
import os
import time

import pytest

from quillgraph.api import Api
from quillgraph.catalog import Manager, Registry, discover, project_root
from quillgraph.cli import main
from quillgraph.streaming import changes


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("work") / "one"
    (d / "svc").mkdir(parents=True)
    (d / "package.json").write_text("{}")
    (d / "svc" / "_a.py").write_text("def step(n):\n    return n\n\ndef run():\n    return step(1)\n")
    (d / "b.ts").write_text("import { x } from './svc/x';\nexport function go() { return run(); }\napp.get('/go', go);\n")
    return d


@pytest.fixture(scope="module")
def api(spark, root):
    api = Api(Manager(spark, Registry(str(root.parent / "registry.json"))))
    api.m.register(str(root), "One")
    return api


def rpc(api, name, **args):
    out = api.rpc(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}}))
    return json.loads(out["result"]["content"][0]["text"]) if "result" in out else out["error"]


def test_tools(api):
    assert rpc(api, "kb_search", query="step")[0]["name"] == "step"
    x = rpc(api, "kb_explore", query="step")
    assert [c["name"] for c in x["callers"]] == ["run"] and x["verbatimSource"][0]["lines"][0]["content"] == "def step(n):" and x["freshness"]["isFresh"]
    i = rpc(api, "kb_impact", target="step")
    assert i["direct_callers"] == 1 and i["transitive_callers"] == 2 and i["riskScore"] == "CRITICAL"
    assert rpc(api, "kb_god_nodes")["godNodes"] and rpc(api, "kb_architecture")["totalFiles"] == 3
    assert rpc(api, "kb_nope")["code"] == -32000 and api.rpc("{")["error"]["code"] == -32700 and api.rpc('{"method": "x"}')["error"]["code"] == -32601
    assert len(api.rpc('{"method": "tools/list", "id": 2}')["result"]["tools"]) == 11


def test_rest_and_cli(api, spark, root, capsys):
    assert api.rest("/v1/search", {"query": "go"})[0] == 200 and api.rest("/v1/impact", {})[0] == 400 and api.rest("/nope", {})[0] == 404
    assert "<svg" in api.rest("/visual", {})[2] and "# Knowledge base" in json.loads(api.rest("/v1/context", {})[2])["markdown"]
    args = ["--registry", str(root.parent / "registry.json")]
    assert main([*args, "audit-impact", "step", "--max-risk", "HIGH"], spark) == 1 and main([*args, "audit-impact", "go", "--max-risk", "CRITICAL"], spark) == 0
    assert project_root(str(root / "svc")) == str(root)


def test_incremental_equals_full(api, root):
    e = api.m.engine("One")
    (root / "svc" / "_a.py").write_text("def step(n):\n    return more(n)\n\ndef more(n):\n    return n\n")
    os.utime(root / "svc" / "_a.py", (time.time() + 5,) * 2)
    (root / "c.py").write_text("def last():\n    return more(1)\n")
    (root / "b.ts").unlink()
    assert e.needs_heal() and rpc(api, "kb_sync", workspace="One")["success"] and not e.needs_heal()
    assert e.refresh() == {"insert": 0, "update": 0, "delete": 0}

    def rows():
        return {t: sorted(map(str, e.tables[t].select(*[c for c in e.tables[t].columns if c not in ("mtime_ms",)]).collect())) for t in ("files", "nodes", "edges")}

    part = rows()
    e.index()
    assert rows() == part
    (root / "d.py").write_text("def stream():\n    return last()\n")
    q = changes.watch(e, str(root.parent / "ck"), once=True)
    q.awaitTermination()
    assert e.search("stream")[0]["name"] == "stream" and changes.status(q)["active"] is False


def test_registry(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "go.mod").write_text("")
    r = Registry(str(tmp_path / "r.json"))
    assert [w["name"] for w in discover([str(tmp_path)], r)] == ["a"] and r.active()["name"] == "a"
    inner = r.register(str(tmp_path / "a" / "b"), "inner")
    assert r.find(str(tmp_path / "a" / "b" / "x"))["id"] == inner["id"] and r.find("INNER")["id"] == inner["id"] and r.find("nope") is None
    assert Registry(str(tmp_path / "r.json")).list() == r.list()
    (tmp_path / "a" / "b").rmdir()
    assert r.prune() == [inner["id"]] and r.unregister("a") and r.active() is None


def test_nothing_is_cut_at_500(spark, tmp_path, monkeypatch):
    """A hub's callers, the impact lists, the gate's targets and the report's routes and modules are whole."""
    from quillgraph.engine import Engine
    from quillgraph.operators import report, resolve, traverse

    (tmp_path / "hub.py").write_text("def hub():\n    return 1\n")
    for i in range(6):
        (tmp_path / f"m{i}.py").write_text("".join(f"def caller_{i}_{k}():\n    return hub()\n\n" for k in range(100)))
    engine = Engine(spark, str(tmp_path), str(tmp_path / ".store"))
    engine.index()
    x = engine.explore("hub")
    assert len([c for c in x["callers"] if c["name"].startswith("caller_")]) == 600
    assert {f"m{i}.py" for i in range(6)} <= set(x["impactRadius"]["affectedFiles"]) and len(x["impactRadius"]["directAffected"]) >= 600
    monkeypatch.setattr(resolve, "seed", lambda nodes, t: t)
    monkeypatch.setattr(traverse, "audit", lambda nodes, edges, seeds, *a: seeds.selectExpr("seed", "'LOW' as risk", "seed < 't0700' as passed").orderBy("seed"))
    got = engine.audit([f"t{i:04}" for i in range(701)])
    assert not got["passed"] and got["failedCount"] == 1 and len(got["results"]) == 701
    routes = spark.range(700).selectExpr("concat('GET /', id) as name", "concat('d', id, '/f.py') as file_path", "'route' as kind", "concat('route:', id) as id", "id as ord", "1 as start_line")
    files = spark.range(700).selectExpr("concat('d', id, '/f.py') as path", "1 as node_count")
    text = report.markdown({"totalFiles": 0, "totalNodes": 0, "totalEdges": 0, "nodesByKind": {}, "godNodes": []}, routes, files)
    assert text.count("- `GET /") == 700 and text.count("### d") == 700
