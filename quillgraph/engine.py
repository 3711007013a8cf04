"""A workspace's graph: index, refresh, query. The façade that the servers and the command line use."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import parse, schema
from quillgraph.functions import text
from quillgraph.functions.frames import checkpoint
from quillgraph.operators import fresh, metrics, report, resolve, search, traverse
from quillgraph.sources import workspace
from quillgraph.sources.store import Conflict, Store, read_json


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str | None = None):
        self.spark, self.root = spark, os.path.abspath(root)
        self.store = Store(spark, store or os.path.join(self.root, ".quillgraph"))
        self._tables: dict[str, DataFrame] | None = None
        self._stats: dict | None = None
        self.library = report.Library()
        workspace.register(spark)

    # building

    def scan(self, content: bool = True) -> DataFrame:
        """The tree as it is now: path, size, mtime_ms, content (null if not asked for)."""
        return self.spark.read.format("workspace").option("content", str(content).lower()).load(self.root)

    def _save(self, files: DataFrame, nodes: DataFrame, edges: DataFrame) -> None:
        """A new version from all files' own versions of nodes and edges: they alone decide, so its history does not matter."""
        one, raw = checkpoint(parse.settled(nodes)), checkpoint(parse.settled(edges))
        tables = {"files": files, "parsed_nodes": nodes, "parsed_edges": edges, "nodes": one, "edges": resolve.resolve(one, raw), "tokens": search.token_index(one), "asks": resolve.asks(raw)}
        self.store.save(tables)
        self._tables = self._stats = None

    def index(self) -> dict:
        """Parse everything and write a new version."""
        disk = checkpoint(self.scan())
        nodes, edges = parse.versions(checkpoint(parse.parsed(disk)))
        self._save(parse.file_rows(disk, nodes, edges), nodes, edges)
        return self.stats()

    def load_json(self, path: str) -> dict:
        """Replace the graph by an exported one."""
        got = read_json(self.spark, path)
        nodes, edges = (checkpoint(got[t]) for t in ("nodes", "edges"))
        self._save(checkpoint(got["files"]), nodes, edges)
        return self.stats()

    def refresh(self, disk: DataFrame | None = None, quick: bool = False) -> dict[str, int]:
        """Compare the tree with the graph by hash and apply the difference: counts of insert, update, delete.

        ``quick`` reads only files that are new or whose time has changed. If another writer is faster, the comparison
        starts anew from its version.
        """
        while True:
            base = self.store.manifest()
            if base is None:
                self.index()
                return {"insert": self.tables["files"].count(), "update": 0, "delete": 0}
            files = self.store.table(base, "files")
            now = self._suspects(files) if quick and disk is None else checkpoint(self.scan() if disk is None else disk).withColumn("hash", text.content_hash(F.coalesce("content", F.lit(""))))
            changed = checkpoint(fresh.reconcile(files, now))
            n = {r.change: r["count"] for r in changed.groupBy("change").count().collect()}
            try:
                if n:
                    self._apply(base, now, changed)
                self._tables = self._stats = None
                return {k: n.get(k, 0) for k in ("insert", "update", "delete")}
            except Conflict:
                continue

    def _suspects(self, files: DataFrame) -> DataFrame:
        """The tree with hashes; contents are read only where the time is not the indexed one."""
        listed = checkpoint(self.scan(content=False).drop("content").join(files.select("path", F.col("hash").alias("__hash"), F.col("mtime_ms").alias("__ms")), "path", "left"))
        odd = listed.where("__ms is null or __ms <> mtime_ms")
        contents = checkpoint(workspace.with_content(odd, self.root))
        rows = listed.join(contents, "path", "left").where("content is not null or __ms = mtime_ms")
        return rows.select("path", "size", "mtime_ms", "content", F.coalesce(text.content_hash(F.col("content")), "__hash").alias("hash"))

    def _apply(self, base: dict, disk: DataFrame, changed: DataFrame) -> None:
        """A version in which changed files' rows are new: only the buckets that hold such rows, or edges that resolve anew for them, are written."""
        store = self.store
        new = checkpoint(disk.join(changed.where("change <> 'delete'").select("path"), "path", "left_semi"))
        nodes, edges = parse.versions(checkpoint(parse.parsed(new)))
        paths = changed.select(F.col("path").alias("file_path"))
        now = {t: store.table(base, t) for t in base["data"]}

        def touched(t: str, rows: DataFrame) -> list[int]:
            return [r[0] for r in rows.select(store.bucket(t, base["buckets"])).distinct().collect()]

        def settle(parsed: DataFrame, rows: DataFrame, ids: DataFrame) -> DataFrame:
            return checkpoint(parse.settled(parsed.join(paths, "file_path", "left_anti").unionByName(rows).join(ids, "id", "left_semi")))

        homes = touched("files", changed)
        own = {t: store.table(base, t, homes) for t in ("files", "parsed_nodes", "parsed_edges")}
        gone = {t: own[t].join(paths, "file_path", "left_semi").select("id") for t in ("parsed_nodes", "parsed_edges")}
        ids = checkpoint(gone["parsed_nodes"].union(nodes.select("id")).distinct())
        before = checkpoint(now["nodes"].join(ids, "id", "left_semi"))
        after = settle(now["parsed_nodes"], nodes, ids)
        rest = now["nodes"].join(ids, "id", "left_anti")
        asking = resolve.changed_asks(now["asks"], before, after, rest)
        edge_ids = checkpoint(gone["parsed_edges"].union(edges.select("id")).union(asking).distinct())
        raw = settle(now["parsed_edges"], edges, edge_ids)
        resolved = resolve.resolve(resolve.candidates(rest.unionByName(after), raw), raw)
        at_nodes = touched("nodes", before.select("id").union(after.select("id")))
        at_edges = touched("edges", raw.select("source_id").union(now["edges"].join(edge_ids, "id", "left_semi").select("source_id")))
        one = checkpoint(store.table(base, "nodes", at_nodes).join(ids, "id", "left_anti").unionByName(after))
        store.change(base, {
            "files": (fresh.upsert(own["files"], parse.file_rows(new, nodes, edges), changed, "path"), homes),
            "parsed_nodes": (fresh.upsert(own["parsed_nodes"], nodes, changed), homes), "parsed_edges": (fresh.upsert(own["parsed_edges"], edges, changed), homes),
            "nodes": (one, at_nodes), "tokens": (search.token_index(one), at_nodes),
            "edges": (store.table(base, "edges", at_edges).join(edge_ids, "id", "left_anti").unionByName(resolved), at_edges),
            "asks": (store.table(base, "asks", at_edges).join(edge_ids, "id", "left_anti").unionByName(resolve.asks(raw)), at_edges),
        })

    @property
    def tables(self) -> dict[str, DataFrame]:
        if self._tables is None:
            self._tables = self.store.load()
            if self._tables is None:
                self.index()
                self._tables = self.store.load()
        return self._tables

    @property
    def nodes(self) -> DataFrame:
        return self.tables["nodes"]

    @property
    def edges(self) -> DataFrame:
        return self.tables["edges"]

    # asking

    def _rows(self, df: DataFrame) -> list[dict]:
        return [json.loads(r) for r in df.toJSON().collect()]

    def search(self, query: str, limit: int = 10) -> list[dict]:
        return self._rows(search.search(self.nodes, query, limit, self.tables["tokens"]))

    def impact(self, target: str, depth: int = 5) -> dict:
        row = self._rows(traverse.impact_of(self.nodes, self.edges, target, depth))[0]
        return {"target": target, "riskScore": row["risk"], **row}

    def audit(self, targets: list[str], max_risk: str = "HIGH", depth: int = 5) -> dict:
        """The gate over many targets at once."""
        seeds = resolve.seeds(self.nodes, self.spark.createDataFrame([(t,) for t in targets], "seed string"))
        rows = self._rows(traverse.audit(self.nodes, self.edges, seeds, max_risk, depth))
        failed = sum(not r["passed"] for r in rows)
        return {"passed": not failed, "failedCount": failed, "maxRisk": max_risk, "results": rows}

    def explore(self, query: str, depth: int = 3) -> dict:
        found = self._rows(resolve.find_by_name(self.nodes, query).drop("ord")) or [self._rows(self.nodes.where(F.col("id") == r["id"]).drop("ord"))[0] for r in self.search(query, 5)]
        if not found:
            return {"query": query, "targetNodes": [], "callers": [], "callees": [], "callPaths": [], "relatedDocs": [], "verbatimSource": [], "freshness": self.freshness([])}
        first = found[0]
        near = {side: self._rows(traverse.neighbours(self.nodes, self.edges, first["id"], side)) for side in ("callers", "callees")}
        paths = sorted({first["file_path"], *(r["file_path"] for rows in near.values() for r in rows)})
        state = self.freshness(paths)
        steps = self.spark.createDataFrame([(query, first["id"])], "seed string, id string")
        reached = self._rows(traverse.impact_levels(self.nodes, self.edges, steps, depth))
        out = {
            "query": query, "targetNodes": found, **near, "callPaths": self._rows(traverse.call_paths(self.nodes, self.edges, first["id"])),
            "impactRadius": {"directAffected": [r["id"] for r in reached if r["depth"] == 1], "transitiveAffected": [r["id"] for r in reached if r["depth"] > 1], "affectedFiles": sorted({r["file_path"] for r in reached if r.get("file_path")})},
            "verbatimSource": self.source(first), "relatedDocs": self._rows(traverse.related_docs(self.nodes, self.edges, first["id"])), "freshness": state,
        }
        if state["isStale"]:
            out["stalenessWarning"] = f"Warning: graph data for {', '.join(paths)} may be stale due to: {state['staleReason']}"
        return out

    def source(self, node: dict, around: int = 2) -> list[dict]:
        """The node's lines with two more on each side."""
        at = os.path.join(self.root, node["file_path"])
        if not os.path.isfile(at):
            return []
        lines = workspace.read(self.root, node["file_path"]).split("\n")
        a, b = max(1, node["start_line"] - around), min(len(lines), node["end_line"] + around)
        return [{"filePath": node["file_path"], "startLine": a, "endLine": b, "lines": [{"lineNumber": i, "content": lines[i - 1]} for i in range(a, b + 1)]}]

    def freshness(self, paths: list[str]) -> dict:
        asked = self.spark.createDataFrame([(p,) for p in paths], "path string")
        disk = [(p, workspace.read(self.root, p), os.stat(os.path.join(self.root, p)).st_mtime_ns / 1e6) for p in paths if os.path.isfile(os.path.join(self.root, p))]
        now = self.spark.createDataFrame(disk, "path string, content string, mtime_ms double").withColumn("hash", text.content_hash(F.col("content")))
        row = fresh.freshness_summary(fresh.freshness(self.tables["files"], now, asked)).first()
        return {"isFresh": not row.is_stale, "isStale": row.is_stale, "staleReason": row.reason, "contentHash": row.content_hash, "pendingInQueue": False}

    def needs_heal(self) -> bool:
        return fresh.needs_heal(self.tables["files"], self._suspects(self.tables["files"])).first().heal

    def pending(self) -> list[str]:
        """Paths that wait to be indexed: new, gone or with another time."""
        listed = self.scan(content=False).select("path", F.col("mtime_ms").alias("now_ms"))
        rows = listed.join(self.tables["files"].select("path", "mtime_ms"), "path", "full_outer").where("not now_ms <=> mtime_ms")
        return sorted(r.path for r in rows.select("path").collect())

    def god_nodes(self, limit: int = 10) -> list[dict]:
        return self._rows(metrics.god_nodes(self.nodes, self.edges, limit, metrics.ONE_TASK))

    def stats(self) -> dict:
        if self._stats is None:  # once per graph version
            self._stats = metrics.stats(self.nodes, self.edges, self.tables["files"]) | {"godNodes": self.god_nodes()}
        return self._stats

    def report(self) -> str:
        return report.markdown(self.stats(), self.nodes, self.tables["files"])

    def docs(self, query: str) -> str:
        """Registered library documents that a query names, and nodes of that name."""
        return self.library.resolve(query, self.nodes)

    def visual(self) -> str:
        return report.html(self.nodes, self.edges)

    def diagnose(self) -> dict:
        """Counts of the graph's integrity, and files that it names and the tree lacks."""
        missing = metrics.missing_files(self.nodes, self.scan(content=False))
        found = missing.groupBy().agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first")).first()
        return self._rows(metrics.diagnose(self.nodes, self.edges))[0] | {"missing_files": found.n, "first_missing": found.first}

    def export(self, path: str | None = None) -> str:
        """The graph as one JSON file; its path."""
        path = path or os.path.join(tempfile.mkdtemp(prefix="quill-"), "graph.json")
        self.store.export_json(path)
        return path
