"""Refreshes against full indexes where files share ids, the store's versions, JSON, the scan, and small parts."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.engine import Engine
from quillgraph.operators import resolve, search
from quillgraph.sources import workspace
from quillgraph.streaming import changes


def rows(e):
    return {t: sorted(map(str, e.tables[t].drop("mtime_ms").collect())) for t in ("files", "nodes", "edges", "tokens")}


def write(path, text, later):
    path.write_text(text)
    os.utime(path, (time.time() + later,) * 2)


def test_shared_ids_refresh_equals_index(spark, tmp_path):
    """Two files register one route: an edit, the deletion of the file whose row counts, and of the other."""
    root = tmp_path / "w"
    root.mkdir()
    one = "app.get('/same', go);\nfunction go() { return 1; }\n"
    for name in "abc":
        (root / f"{name}.ts").write_text(one)
    e = Engine(spark, str(root), str(tmp_path / "s1"))
    e.index()
    assert e.nodes.where("kind = 'route'").count() == 1
    for later, step in enumerate((lambda: write(root / "a.ts", one + "function more() { return go(); }\n", 9), lambda: (root / "c.ts").unlink(), lambda: (root / "a.ts").unlink()), 1):
        step()
        assert e.pending() and sum(e.refresh(quick=later % 2 == 0).values()) == 1 and not e.pending()
        full = Engine(spark, str(root), str(tmp_path / f"full{later}"))
        full.index()
        assert rows(e) == rows(full)


def test_resolution_keeps_the_number_of_edges(spark):
    n = spark.createDataFrame([("a", "A", "class", "f", 0), ("a", "A", "class", "g", 1)], "id string, name string, kind string, file_path string, ord long")
    e = spark.createDataFrame([("s", "a", None, "calls", "f", 1, 0)], "source_id string, target_id string, target_name string, kind string, file_path string, line int, ord long")
    assert resolve.resolve(n, e).count() == 1
    assert {r.seed: r.id for r in resolve.seeds(n, spark.createDataFrame([("A",), ("a",), ("zz",)], "seed string")).collect()} == {"A": "a", "a": "a", "zz": "zz"}


def test_store_versions_and_json(spark, tmp_path):
    root = tmp_path / "w"
    (root / "lib").mkdir(parents=True)
    (root / "a.py").write_text("def step(n):\n    return n\n\ndef run():\n    return step(1)\n")
    (root / "lib" / "b.md").write_text("# Guide\nSee `step()`.\n")
    e = Engine(spark, str(root), str(tmp_path / "s"))
    e.index()
    first = e.store.version()
    os.makedirs(tmp_path / "s" / "v000000000000009-dead")  # a writer that died
    assert e.store.version() == first
    e.index()
    assert e.store.version() > "v000000000000009" and sorted(n[-4:] != "dead" for n in os.listdir(tmp_path / "s") if n.startswith("v")) == [True, True]
    path = e.export(str(tmp_path / "graph.json"))
    got = json.load(open(path))
    assert set(got["files"]) == {"a.py", "lib/b.md"} and {"id", "filePath", "startLine"} <= set(got["nodes"][0]) and got["files"]["a.py"]["lastModified"] > 0
    other = Engine(spark, str(root), str(tmp_path / "t"))
    other.load_json(path)
    ids = lambda x, t: sorted(r.id for r in x.tables[t].collect())
    assert ids(other, "nodes") == ids(e, "nodes") and ids(other, "edges") == ids(e, "edges") and other.search("step")[0]["highlight"] == "def step(n):"
    assert other.diagnose()["missing_files"] == 0
    (root / "a.py").unlink()
    assert other.diagnose()["missing_files"] == 1 and other.diagnose()["first_missing"] == "a.py"


def test_search_by_index_equals_search_by_scan(spark):
    r = random.Random(5)
    words = ["load", "Load", "userProfile", "HTTP", "io", "x1", "order_line"]
    made = [(f"n{i}", "".join(r.choice(words) for _ in range(2)), r.choice(["class", "function", "doc_section"]), f"src/{r.choice(words)}.py", r.choice(words) + "(" + r.choice(words) + ")", i) for i in range(200)]
    n = spark.createDataFrame(made, "id string, name string, kind string, file_path string, signature string, ord long")
    index = search.token_index(n)
    for q in ("load", "user profile", "HTTP io", "x1", "orderline", "nothing here", ""):
        assert search.search(n, q, 30).collect() == search.search(n, q, 30, index).collect()


def test_scan_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workspace, "PART_FILES", 3)
    for i in range(10):
        (tmp_path / f"f{i}.py").write_text(f"x = {i}\n")
    parts = workspace.Reader(str(tmp_path), True).partitions()
    assert [len(p.files) for p in parts] == [3, 3, 3, 1]
    workspace.register(spark)
    got = spark.read.format("workspace").load(str(tmp_path)).select("path", "content").collect()
    assert {r.path: r.content for r in got} == {f"f{i}.py": f"x = {i}\n" for i in range(10)}
    assert spark.read.format("workspace").option("content", "false").load(str(tmp_path)).where(F.col("content").isNotNull()).count() == 0
    listed = spark.createDataFrame([("f1.py",), ("gone.py",)], "path string")
    assert [(r.path, r.content) for r in workspace.with_content(listed, str(tmp_path)).collect()] == [("f1.py", "x = 1\n")]


class Query:
    def __init__(self, active, error=None):
        self.isActive, self.error = active, error

    def exception(self):
        return self.error


def test_head_watcher_and_supervisor(tmp_path):
    class Fake:
        root, calls = str(tmp_path), 0

        def refresh(self):
            self.calls += 1

    assert changes.git_head(str(tmp_path)) is None
    (tmp_path / ".git" / "refs" / "heads").mkdir(parents=True)
    (tmp_path / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (tmp_path / ".git" / "refs" / "heads" / "main").write_text("aa\n")
    e = Fake()
    w = changes.HeadWatcher(e)
    assert not w.check()
    (tmp_path / ".git" / "refs" / "heads" / "main").write_text("bb\n")
    assert w.check() and not w.check() and e.calls == 1
    (tmp_path / ".git" / "HEAD").write_text("cc\n")
    assert w.check() and e.calls == 2
    queries = {"a": Query(False, "lost"), "b": Query(True)}
    assert changes.supervise(queries, lambda key: Query(True), pause=0, rounds=2) == 1 and queries["a"].isActive
    assert changes.supervise({"a": Query(False)}, None, pause=0) == 0


def test_config(tmp_path):
    home = str(tmp_path / "home")
    assert config.memory_path(home) == home
    config.set_memory_path(str(tmp_path / "mem"), home)
    assert config.memory_path(home) == str(tmp_path / "mem") and os.path.isdir(tmp_path / "mem")
    (tmp_path / "home" / "config.json").write_text("{broken")
    assert config.memory_path(home) == home


def test_discovery_again_and_savings(spark, tmp_path):
    from quillgraph.catalog import Registry, watch_discover
    from quillgraph.functions import text

    (tmp_path / "in" / "one").mkdir(parents=True)
    (tmp_path / "in" / "one" / "go.mod").write_text("")
    r = Registry(str(tmp_path / "r.json"))
    assert [w["name"] for w in watch_discover([str(tmp_path / "in"), str(tmp_path / "none")], r, 0, 2)] == ["one"]
    row = spark.sql("SELECT 250L AS a, 1000L AS b, 0L AS z").select(text.savings(F.col("a"), F.col("b")).alias("s"), text.savings(F.col("z"), F.col("z")).alias("none")).first()
    assert (row.s, row.none) == (75.0, 0.0)


def test_rest_files_and_errors(spark, tmp_path):
    from quillgraph.api import Api
    from quillgraph.catalog import Manager, Registry

    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.py").write_text("def step(n):\n    return n\n")
    api = Api(Manager(spark, Registry(str(tmp_path / "r.json"))))
    assert api.rest("/v1/stats", {})[0] in (400, 404)
    api.m.register(str(tmp_path / "w"), "W")
    status, kind, body = api.rest("/v1/graph", {})
    assert status == 200 and {n["name"] for n in json.loads(body)["nodes"]} == {"a.py", "step"}
    assert api.rest("/v1/search", {"query": "step", "limit": [1]})[0] in (400, 500)
    tools = {t["name"]: t["inputSchema"] for t in api.rpc('{"method": "tools/list", "id": 2}')["result"]["tools"]}
    assert tools["kb_explore"]["properties"]["maxDepth"]["type"] == "integer" and tools["kb_search"]["required"] == ["query"]
    page = api.rest("/visual", {})[2]
    assert 'id="kind"' in page and 'id="hubs"' in page


def test_reports_and_library(spark, tmp_path):
    from quillgraph.operators import report

    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.py").write_text("def step(n):\n    return n\n\ndef run():\n    return step(1)\n")
    e = Engine(spark, str(tmp_path / "w"), str(tmp_path / "s"))
    e.index()
    hubs = report.hub_report(e.god_nodes()).split("\n")
    assert hubs[2] == "| symbol | file | degree |" and {"| step | a.py | 2 |", "| run | a.py | 2 |"} <= set(hubs)
    assert report.staleness_banner([]) is None and report.staleness_banner([f"f{i}" for i in range(9)]) == "9 file(s) wait to be indexed: f0, f1, f2, f3, f4"
    e.library.register("Lib", "Intro", "How to step.", "2.0")
    e.library.register("other", "Notes", "Nothing.")
    said = e.docs("lib")
    assert "## Lib 2.0: Intro\nHow to step." in said and "Nothing" not in said and "- `step` (function) in a.py" in e.docs("step")
