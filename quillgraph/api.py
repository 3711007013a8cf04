"""JSON-RPC tools and REST routes over one façade, and thin servers for both."""

from __future__ import annotations

import json
import os
import shutil
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qsl, urlsplit

from quillgraph.catalog import Manager

MAX_BODY = 5 << 20
PARSE_ERROR, NO_METHOD, FAILED = -32700, -32601, -32000


class Api:
    def __init__(self, manager: Manager):
        self.m = manager
        e = lambda a: manager.engine(a.get("workspace"))
        number = lambda a, *keys, default: int(next((a[k] for k in keys if a.get(k) is not None), default))
        #: Arguments that a tool takes beside those it needs.
        self.options = {"kb_explore": ["maxDepth"], "kb_impact": ["maxDepth", "depth"], "kb_search": ["limit"], "kb_god_nodes": ["limit"], "kb_register": ["name"]}
        self.tools: dict[str, tuple[list[str], Callable[[dict], object]]] = {
            "kb_explore": (["query"], lambda a: e(a).explore(a["query"], number(a, "maxDepth", default=3))),
            "kb_impact": (["target"], lambda a: e(a).impact(a["target"], number(a, "maxDepth", "depth", default=5))),
            "kb_search": (["query"], lambda a: e(a).search(a["query"], number(a, "limit", default=20))),
            "kb_architecture": ([], lambda a: e(a).stats()),
            "kb_god_nodes": ([], lambda a: {"godNodes": e(a).god_nodes(number(a, "limit", default=10))}),
            "kb_status": ([], lambda a: {"workspaces": manager.registry.list()} if a.get("workspace") == "all" else {"stats": e(a).stats(), "needsHeal": e(a).needs_heal()}),
            "kb_sync": ([], lambda a: {"success": True, "changes": manager.sync(a.get("workspace"))}),
            "kb_workspaces": ([], lambda a: {"workspaces": manager.registry.list()}),
            "kb_register": (["path"], lambda a: {"success": True, "workspace": manager.register(a["path"], a.get("name"))}),
            "kb_unregister": (["workspace"], lambda a: {"success": True, "workspace": manager.unregister(a["workspace"])}),
            "kb_switch": (["workspace"], lambda a: {"success": True, "workspace": manager.registry.switch(a["workspace"])}),
        }
        tool = lambda name: self.tools[name][1]
        at = lambda a: {"workspace": e(a).root}
        self.routes: dict[str, Callable[[dict], object]] = {
            "/v1/health": lambda a: {"status": "ok", "stats": e(a).stats()}, "/v1/workspaces": lambda a: {"activeWorkspace": manager.registry.active(), "workspaces": manager.registry.list()},
            "/v1/workspaces/register": self._register, "/v1/workspaces/switch": self._switch, "/v1/workspaces/unregister": self._unregister,
            "/v1/stats": lambda a: at(a) | e(a).stats(), "/v1/context": lambda a: {"markdown": e(a).report()}, "/v1/explore": tool("kb_explore"), "/v1/impact": tool("kb_impact"), "/v1/graph/impact": tool("kb_impact"),
            "/v1/search": tool("kb_search"), "/v1/god-nodes": lambda a: at(a) | tool("kb_god_nodes")(a), "/v1/sync": tool("kb_sync"),
        }
        #: Routes whose answer is a file, which may be larger than memory.
        self.files: dict[str, Callable[[dict], str]] = dict.fromkeys(("/v1/graph", "/v1/graph/data"), lambda a: e(a).export())

    def _register(self, a: dict) -> dict:
        entry = self.m.register(a["path"], a.get("name"))
        return {"success": True, "message": f"Workspace '{entry['name']}' registered and indexed.", "workspace": entry, "stats": self.m.engine(entry["id"]).stats()}

    def _switch(self, a: dict) -> dict:
        entry = self.m.registry.switch(a["workspace"])
        return {"success": True, "message": f"Switched active workspace to '{entry['name']}'.", "activeWorkspace": entry}

    def _unregister(self, a: dict) -> dict:
        known = self.m.registry.find(a["workspace"]) is not None
        if known:
            self.m.unregister(a["workspace"])
        return {"success": known, "message": f"Workspace '{a['workspace']}' " + ("unregistered successfully." if known else "not found.")}

    def schema(self, name: str) -> dict:
        needed = self.tools[name][0]
        own = {p: {"type": "string"} for p in needed} | {p: {"type": "string" if p == "name" else "integer"} for p in self.options.get(name, [])}
        return {"type": "object", "properties": own | {"workspace": {"type": "string"}}, "required": needed}

    def call(self, name: str, args: dict) -> object:
        if name not in self.tools:
            raise ValueError(f"unknown tool: {name}")
        needed, run = self.tools[name]
        if missing := [k for k in needed if not args.get(k)]:
            raise ValueError(f"missing argument: {', '.join(missing)}")
        return run(args)

    def rpc(self, line: str) -> dict | None:
        """The answer to one JSON-RPC request; None for notifications."""
        try:
            r = json.loads(line)
        except ValueError:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": "parse error"}}
        id_, method, params = r.get("id"), r.get("method"), r.get("params") or {}
        out: dict = {"jsonrpc": "2.0", "id": id_}
        if method == "notifications/initialized":
            return None
        if method == "ping":
            return out | {"result": {}}
        if method == "initialize":
            return out | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quillgraph", "version": "1"}}}
        if method == "tools/list":
            return out | {"result": {"tools": [{"name": k, "inputSchema": self.schema(k)} for k in self.tools]}}
        if method != "tools/call":
            return out | {"error": {"code": NO_METHOD, "message": f"method not found: {method}"}}
        try:
            return out | {"result": {"content": [{"type": "text", "text": json.dumps(self.call(params.get("name"), params.get("arguments") or {}))}]}}
        except Exception as error:
            return out | {"error": {"code": FAILED, "message": str(error)}}

    def rest(self, path: str, args: dict) -> tuple[int, str, str]:
        """(status, content type, body) of one request."""
        if path in ("/", "/visual"):
            return 200, "text/html", self.m.engine(args.get("workspace")).visual()
        if path not in self.routes and path not in self.files:
            return 404, "application/json", json.dumps({"error": "not found"})
        try:
            if path in self.files:
                made = self.files[path](args)
                with open(made, encoding="utf-8") as f:
                    text = f.read()
                shutil.rmtree(os.path.dirname(made), ignore_errors=True)
                return 200, "application/json", text
            return 200, "application/json", json.dumps(self.routes[path](args))
        except KeyError as error:
            return 400, "application/json", json.dumps({"error": f"missing argument: {error.args[0]}"})
        except ValueError as error:
            return 404 if "not found" in str(error) else 400, "application/json", json.dumps({"error": str(error)})
        except Exception as error:
            return 500, "application/json", json.dumps({"error": f"{type(error).__name__}: {error}"})


def serve_stdio(api: Api) -> None:
    for line in sys.stdin:
        if line.strip() and (answer := api.rpc(line)) is not None:
            print(json.dumps(answer), flush=True)


def serve_http(api: Api, port: int = 7890) -> HTTPServer:
    """A local server; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body: bytes = b"") -> None:
            url = urlsplit(self.path)
            args = dict(parse_qsl(url.query))
            try:
                args |= json.loads(body) if body else {}
            except (ValueError, TypeError):
                return self._send(400, "application/json", json.dumps({"error": "bad JSON"}))
            if url.path not in api.files:
                return self._send(*api.rest(url.path, args))
            try:
                path = api.files[url.path](args)  # before any header, so that its errors have a status of their own
            except Exception as error:
                return self._send(404 if "not found" in str(error) else 500, "application/json", json.dumps({"error": str(error)}))
            try:
                self._send_file(path)
            finally:
                shutil.rmtree(os.path.dirname(path), ignore_errors=True)

        def _send(self, status: int, kind: str, text: str) -> None:
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.end_headers()
            self.wfile.write(text.encode())

        def _send_file(self, path: str) -> None:
            self.send_response(200)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(os.path.getsize(path)))
            self.end_headers()
            with open(path, "rb") as f:
                shutil.copyfileobj(f, self.wfile)

        def do_GET(self) -> None:
            self._answer()

        def do_DELETE(self) -> None:
            self._answer()

        def do_POST(self) -> None:
            n = int(self.headers.get("Content-Length") or 0)
            if n > MAX_BODY:
                self.send_error(413)
            else:
                self._answer(self.rfile.read(n))

        def log_message(self, *_) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
