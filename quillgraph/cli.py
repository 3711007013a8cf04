"""Command line: ``python -m quillgraph.cli <command>``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from quillgraph import config
from quillgraph.api import Api, serve_http, serve_stdio
from quillgraph.catalog import Manager, Registry, project_root
from quillgraph.operators.report import hub_report, staleness_banner
from quillgraph.sources.workspace import git_changes


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("--registry", default=os.path.join(config.memory_path(), "registry.json"))
    p.add_argument("--workspace")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {"register": ["path"], "unregister": ["target"], "workspaces": [], "switch": ["target"], "init": [], "watch": [], "sync": [], "prune": [], "serve": [], "explore": ["query"], "impact": ["target"], "search": ["query"], "audit-impact": [], "report": [], "visual": [], "diagnose": [], "hubs": [], "pending": [], "export": ["path"], "import": ["path"], "config": [], "help": []}.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if name == "sync":
            c.add_argument("--all", action="store_true")
        if name in ("search", "hubs"):
            c.add_argument("--limit", type=int, default=10)
        if name in ("explore", "impact"):
            c.add_argument("--depth", type=int, default=3 if name == "explore" else 5)
        if name == "watch":
            c.add_argument("--all", action="store_true")
        if name == "config":
            c.add_argument("--memory-path")
        if name == "register":
            c.add_argument("--name")
        if name == "serve":
            c.add_argument("--port", type=int, default=7890)
            c.add_argument("--mcp", action="store_true")
        if name == "audit-impact":
            c.add_argument("targets", nargs="*")
            c.add_argument("--max-risk", default="HIGH", choices=["LOW", "MEDIUM", "HIGH", "CRITICAL"])
            c.add_argument("--depth", type=int, default=5)
            c.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    if a.command == "help":
        p.print_help()
        return 0
    if a.command == "config":
        if a.memory_path:
            config.set_memory_path(a.memory_path)
        print(config.memory_path())
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("quillgraph").getOrCreate()
    m = Manager(spark, Registry(a.registry))
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, indent=1))
    if a.command == "register":
        say(m.register(a.path, a.name))
    elif a.command == "unregister":
        say(m.unregister(a.target))
    elif a.command == "workspaces":
        say(m.registry.list())
    elif a.command == "switch":
        say(m.registry.switch(a.target))
    elif a.command == "init":
        say(m.register(a.workspace or project_root(os.getcwd()) or os.getcwd()))
    elif a.command == "prune":
        say(m.registry.prune())
    elif a.command == "sync":
        say(m.sync("all" if a.all else a.workspace))
    elif a.command == "watch":
        from quillgraph.streaming import changes

        if a.all:
            folder = os.path.join(config.memory_path(), "streams")
            again = lambda key: changes.watch(m.engine(key), os.path.join(folder, key))
            changes.supervise(changes.watch_all(m, folder), again)
        else:
            e = m.engine(a.workspace)
            changes.watch(e, os.path.join(e.root, ".quillgraph", "stream")).awaitTermination()
    elif a.command == "serve":
        api = Api(m)
        serve_stdio(api) if a.mcp else serve_http(api, a.port).serve_forever()
    elif a.command == "audit-impact":
        e = m.engine(a.workspace)
        got = e.audit(a.targets or git_changes(e.root), a.max_risk, a.depth)
        say(got if a.json else "\n".join(f"{r['seed']}: {r['risk']} {'passed' if r['passed'] else 'FAILED'}" for r in got["results"]))
        return int(not got["passed"])
    else:
        e = m.engine(a.workspace)
        if a.command == "import":
            say(e.load_json(a.path))
        else:
            say({
                "explore": lambda: e.explore(a.query, a.depth), "impact": lambda: e.impact(a.target, a.depth), "search": lambda: e.search(a.query, a.limit), "report": e.report, "visual": e.visual, "diagnose": e.diagnose,
                "hubs": lambda: hub_report(e.god_nodes(a.limit)), "pending": lambda: staleness_banner(e.pending()) or "nothing waits", "export": lambda: e.export(a.path),
            }[a.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
