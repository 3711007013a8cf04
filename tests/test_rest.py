"""Bodies of the REST routes, errors and deletions over a real connection."""

import json
import os
import threading
import urllib.error
import urllib.request

from quillgraph.api import Api, serve_http
from quillgraph.catalog import Manager, Registry


def test_bodies_over_http(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.py").write_text("def step(n):\n    return n\n\ndef run():\n    return step(1)\n")
    server = serve_http(Api(Manager(spark, Registry(str(tmp_path / "r.json")))), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, method=None):
        data = None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", data, method=method)
        try:
            with urllib.request.urlopen(request, timeout=200) as got:
                return got.status, json.loads(got.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    try:
        assert ask("/v1/workspaces") == (200, {"activeWorkspace": None, "workspaces": []})
        assert ask("/v1/graph")[0] in (404, 500) and ask("/v1/explore", b"{")[0] == 400 and ask("/nowhere")[0] == 404
        status, made = ask("/v1/workspaces/register", {"path": str(tmp_path / "w"), "name": "W"})
        assert status == 200 and made["success"] and made["workspace"]["name"] == "W" and made["stats"]["totalFiles"] == 1 and "'W'" in made["message"]
        assert ask("/v1/workspaces")[1]["activeWorkspace"]["name"] == "W"
        assert ask("/v1/stats")[1]["workspace"] == str(tmp_path / "w") and ask("/v1/god-nodes?limit=1")[1].keys() == {"workspace", "godNodes"}
        assert ask("/v1/search", {"query": "step"})[1][0]["name"] == "step"
        before = set(os.listdir("/tmp"))
        assert {n["name"] for n in ask("/v1/graph")[1]["nodes"]} == {"a.py", "step", "run"}
        assert not [n for n in set(os.listdir("/tmp")) - before if n.startswith("quill-") and os.path.exists(f"/tmp/{n}/graph.json")]
        assert ask("/v1/workspaces/switch", {"workspace": "W"})[1]["activeWorkspace"]["name"] == "W" and ask("/v1/workspaces/switch", {"workspace": "nope"})[0] == 404
        assert ask("/v1/workspaces/unregister?workspace=nope", method="DELETE") == (200, {"success": False, "message": "Workspace 'nope' not found."})
        assert ask("/v1/workspaces/unregister?workspace=W", method="DELETE")[1]["success"] and ask("/v1/workspaces")[1]["workspaces"] == []
    finally:
        server.shutdown()
