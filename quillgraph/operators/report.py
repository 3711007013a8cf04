"""Reports: a Markdown overview, a hub list, a self-contained HTML page, library documents."""

from __future__ import annotations

import html as entities
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import metrics

HUBS, FILES = 8, 10


def markdown(stats: dict, nodes: DataFrame, files: DataFrame) -> str:
    """Counts, hubs, routes, and per module its first files with their number of nodes."""
    out = ["# Knowledge base", "", "## 1. Overview", ""]
    out += [f"- Files: {stats['totalFiles']}", f"- Nodes: {stats['totalNodes']}", f"- Edges: {stats['totalEdges']}", ""]
    out += ["| kind | nodes |", "|---|---|", *[f"| {k} | {n} |" for k, n in sorted(stats["nodesByKind"].items()) if n], "", "## 2. Hubs", ""]
    out += [f"{i}. `{g['name']}` in {g['file_path']}: degree {g['degree']}, rank {g['page_rank']}" for i, g in enumerate(stats["godNodes"][:HUBS], 1)]
    out += ["", "## 3. Routes", ""] + [f"- `{r.name}` in {r.file_path}" for r in metrics.route_registry(nodes).orderBy("name").collect()]
    module = F.when(F.col("path").contains("/"), F.split("path", "/")[0]).otherwise("root")
    listed = files.select(module.alias("module"), "path", "node_count")
    few = listed.withColumn("k", F.row_number().over(Window.partitionBy("module").orderBy("path"))).where(F.col("k") <= FILES)
    first = few.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("path", "node_count"))).alias("first"))  # at most FILES of each module
    shown = listed.groupBy("module").agg(F.count(F.lit(1)).alias("n")).join(first, "module").orderBy("module").collect()
    out += ["", "## 4. Modules", ""]
    for m in shown:
        out += [f"### {m.module} ({m.n} files)", *[f"- {f.path}: {f.node_count} nodes" for f in m.first], ""]
    return "\n".join(out)


def hub_report(hubs: list[dict]) -> str:
    return "\n".join(["# Hubs", "", "| symbol | file | degree |", "|---|---|---|", *[f"| {h['name']} | {h['file_path']} | {h['degree']} |" for h in hubs]])


def staleness_banner(pending: list[str]) -> str | None:
    return f"{len(pending)} file(s) wait to be indexed: {', '.join(pending[:5])}" if pending else None


def html(nodes: DataFrame, edges: DataFrame, most_nodes: int = 5000, most_edges: int = 15000) -> str:
    """A page that lists the first nodes and draws their edges, with a search box; data is embedded and escaped."""
    shown = [r.asDict() for r in nodes.orderBy("ord").limit(most_nodes).select("id", "name", "kind", "file_path").collect()]
    lines = [r.asDict() for r in metrics.visual_subgraph(nodes, edges, most_nodes, most_edges).collect()]
    data = json.dumps({"nodes": shown, "edges": lines}).replace("<", "\\u003c")
    title = entities.escape(f"{len(shown)} nodes, {len(lines)} edges")
    return f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>body{{font:14px sans-serif}}svg{{border:1px solid #ccc}}</style></head><body>
<h1>{title}</h1><input id="q" placeholder="name"> <select id="kind"><option value="">all kinds</option></select> <label>edges from <input id="hubs" type="number" value="0" min="0" size="4"></label><ul id="list"></ul><svg id="map" width="900" height="900"></svg><script>
const data = {data};
const place = new Map(data.nodes.map((n, i) => [n.id, [450 + 420 * Math.cos(i * 2 * Math.PI / data.nodes.length), 450 + 420 * Math.sin(i * 2 * Math.PI / data.nodes.length)]]));
const by = id => document.getElementById(id), degree = new Map(data.nodes.map(n => [n.id, 0]));
data.edges.forEach(e => [e.source_id, e.target_id].forEach(i => degree.set(i, (degree.get(i) || 0) + 1)));
[...new Set(data.nodes.map(n => n.kind))].sort().forEach(k => by("kind").add(new Option(k, k)));
let picked = null;
const draw = shown => {{ by("map").innerHTML = data.edges.filter(e => shown.has(e.source_id) && shown.has(e.target_id)).map(e => {{ const a = place.get(e.source_id), b = place.get(e.target_id); return `<line x1="${{a[0]}}" y1="${{a[1]}}" x2="${{b[0]}}" y2="${{b[1]}}" stroke="#8888" />`; }}).join(""); }};
const near = id => new Set([id, ...data.edges.flatMap(e => e.source_id === id ? [e.target_id] : e.target_id === id ? [e.source_id] : [])]);
const show = () => {{ const q = by("q").value.toLowerCase(), k = by("kind").value, least = +by("hubs").value, around = picked === null ? null : near(picked); const found = data.nodes.filter(n => n.name.toLowerCase().includes(q) && (!k || n.kind === k) && degree.get(n.id) >= least && (!around || around.has(n.id))); draw(new Set(found.map(n => n.id))); by("list").replaceChildren(...found.slice(0, 50).map(n => {{ const li = document.createElement("li"); li.textContent = `${{n.kind}} ${{n.name}} (${{n.file_path}}), ${{degree.get(n.id)}} edges`; li.onclick = () => {{ picked = picked === n.id ? null : n.id; show(); }}; return li; }})); }};
["q", "kind", "hubs"].forEach(i => by(i).oninput = show); show();
</script></body></html>"""


class Library:
    """Documents by key; a query finds those whose key contains it or whose library it contains."""

    def __init__(self):
        self.docs: dict[str, dict] = {}

    def register(self, library: str, title: str, content: str, version: str = "latest") -> None:
        self.docs[f"{library}@{version}:{title}".lower()] = {"library": library, "title": title, "content": content, "version": version}

    def resolve(self, query: str, nodes: DataFrame, most: int = 5) -> str:
        q = query.lower()
        found = [d for k, d in self.docs.items() if q in k or d["library"].lower() in q]
        near = nodes.where(F.lower("name").contains(q)).orderBy("ord").limit(most).collect()
        return "\n".join([f"# {query}", *[f"## {d['library']} {d['version']}: {d['title']}\n{d['content']}" for d in found], *[f"- `{n.name}` ({n.kind}) in {n.file_path}" for n in near]])
