"""Registered workspaces and a bounded pool of loaded engines."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from quillgraph import schema
from quillgraph.engine import Engine

# Files that mark a project's root.
MARKERS = ["package.json", ".git", "pyproject.toml", "setup.py", "go.mod", "Cargo.toml", "pubspec.yaml", "pom.xml", "build.gradle", "composer.json", "tsconfig.json"]
POOL = 20


class Registry:
    """The list of workspaces, a JSON file that is replaced as a whole."""

    def __init__(self, path: str):
        self.path = path
        self.data = {"activeWorkspaceId": None, "workspaces": {}}
        if os.path.exists(path):
            try:
                with open(path) as f:
                    self.data |= json.load(f)
            except ValueError:
                pass

    def _save(self) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(f"{self.path}.tmp", "w") as f:
            json.dump(self.data, f, indent=1)
        os.replace(f"{self.path}.tmp", self.path)

    @staticmethod
    def id_of(root: str) -> str:
        return hashlib.sha256(os.path.abspath(root).lower().encode()).hexdigest()[:12]

    def register(self, root: str, name: str | None = None) -> dict:
        """Add or rename; the statistics of a known workspace stay, the first one becomes active."""
        root = os.path.abspath(root)
        if not os.path.isdir(root):
            raise ValueError(f"no such folder: {root}")
        old = self.data["workspaces"].get(self.id_of(root), {})
        entry = {"id": self.id_of(root), "name": name or old.get("name") or os.path.basename(root), "rootPath": root, "lastAccessed": int(time.time() * 1000)} | {k: old.get(k, 0) for k in ("totalNodes", "totalEdges", "totalFiles")}
        self.data["workspaces"][entry["id"]] = entry
        self.data["activeWorkspaceId"] = self.data["activeWorkspaceId"] or entry["id"]
        self._save()
        return entry

    def unregister(self, key: str) -> dict | None:
        entry = self.find(key)
        if entry:
            del self.data["workspaces"][entry["id"]]
            if self.data["activeWorkspaceId"] == entry["id"]:
                self.data["activeWorkspaceId"] = next(iter(self.data["workspaces"]), None)
            self._save()
        return entry

    def switch(self, key: str) -> dict:
        entry = self.find(key)
        if not entry:
            raise ValueError(f"workspace not found: {key}")
        self.data["activeWorkspaceId"] = entry["id"]
        self._save()
        return entry

    def active(self) -> dict | None:
        """The active workspace; another one if it has gone."""
        if self.data["activeWorkspaceId"] not in self.data["workspaces"]:
            self.data["activeWorkspaceId"] = next(iter(self.data["workspaces"]), None)
        return self.data["workspaces"].get(self.data["activeWorkspaceId"])

    def find(self, key: str) -> dict | None:
        """By id, then path, then name (both apart from case), then the nearest ancestor of a path."""
        all_ = self.data["workspaces"]
        low, full = key.lower(), os.path.abspath(key).lower()
        tests = (lambda w: w["id"] == key, lambda w: w["rootPath"].lower() == full, lambda w: w["name"].lower() == low)
        return next((w for t in tests for w in all_.values() if t(w)), None) or self.find_by_path(key)

    def find_by_path(self, path: str) -> dict | None:
        full = os.path.abspath(path)
        above = [w for w in self.data["workspaces"].values() if full == w["rootPath"] or full.startswith(w["rootPath"].rstrip("/") + "/")]
        return max(above, key=lambda w: len(w["rootPath"]), default=None)

    def list(self) -> list[dict]:
        active = self.active()
        return [w | {"isCurrent": active is not None and w["id"] == active["id"]} for w in self.data["workspaces"].values()]

    def update_stats(self, id_: str, stats: dict) -> None:
        self.data["workspaces"][id_] |= {k: stats[k] for k in ("totalNodes", "totalEdges", "totalFiles")}
        self._save()

    def prune(self) -> list[str]:
        """Forget workspaces whose folders are gone."""
        gone = [w["id"] for w in self.data["workspaces"].values() if not os.path.isdir(w["rootPath"])]
        for id_ in gone:
            self.unregister(id_)
        return gone

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(w["id"], w["name"], w["rootPath"], w["lastAccessed"], w["totalNodes"], w["totalEdges"], w["totalFiles"]) for w in self.data["workspaces"].values()]
        return spark.createDataFrame(rows, schema.WORKSPACE)


def project_root(path: str) -> str | None:
    """The nearest folder at or above ``path`` that has a marker."""
    at = os.path.abspath(path)
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in MARKERS):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def discover(parents: list[str], registry: Registry) -> list[dict]:
    """Register folders directly below ``parents`` that have a marker and are not known."""
    out = []
    for parent in parents:
        for e in sorted(os.scandir(parent), key=lambda e: e.name):
            if e.is_dir() and any(os.path.exists(os.path.join(e.path, m)) for m in MARKERS) and registry.id_of(e.path) not in registry.data["workspaces"]:
                out.append(registry.register(e.path))
    return out


def watch_discover(parents: list[str], registry: Registry, pause: float = 60.0, rounds: int | None = None) -> list[dict]:
    """Discover again and again, ``pause`` seconds apart; what was registered in ``rounds`` of it (without end if none are given)."""
    found: list[dict] = []
    while rounds is None or rounds > 0:
        found += discover([p for p in parents if os.path.isdir(p)], registry)
        rounds = None if rounds is None else rounds - 1
        time.sleep(pause if rounds is None or rounds else 0)
    return found


class Manager:
    """Engines by workspace, the least recently used one dropped beyond ``size``."""

    def __init__(self, spark: SparkSession, registry: Registry, size: int = POOL):
        self.spark, self.registry, self.size = spark, registry, size
        self.loaded: OrderedDict[str, Engine] = OrderedDict()

    def engine(self, key: str | None = None) -> Engine:
        entry = self.registry.find(key) if key else self.registry.active()
        if not entry:
            raise ValueError(f"workspace not found: {key}" if key else "no active workspace")
        if entry["id"] not in self.loaded:
            while len(self.loaded) >= self.size:
                self.loaded.popitem(last=False)
            self.loaded[entry["id"]] = Engine(self.spark, entry["rootPath"])
        self.loaded.move_to_end(entry["id"])
        return self.loaded[entry["id"]]

    def register(self, path: str, name: str | None = None) -> dict:
        entry = self.registry.register(path, name)
        self.registry.update_stats(entry["id"], self.engine(entry["id"]).index())
        return self.registry.find(entry["id"])

    def unregister(self, key: str) -> dict:
        entry = self.registry.unregister(key)
        if not entry:
            raise ValueError(f"workspace not found: {key}")
        self.loaded.pop(entry["id"], None)
        return entry

    def sync(self, key: str | None = None) -> dict:
        """Refresh one workspace, or every registered one for ``all``."""
        keys = list(self.registry.data["workspaces"]) if key == "all" else [key]
        return {self.registry.find(k)["id"] if k else self.registry.active()["id"]: self.engine(k).refresh() for k in keys}
