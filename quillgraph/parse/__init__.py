"""Parsers: one file in, nodes and edges out, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.functions import text
from quillgraph.functions.frames import last_writer
from quillgraph.parse import languages, script
from quillgraph.parse.base import Graph

#: Parser of each language; others get a file node only. Add to it to extend the engine.
PARSERS: dict[str, Callable[[Graph], None]] = {
    "typescript": script.parse_script, "javascript": script.parse_script, "vue": script.parse_component, "svelte": script.parse_component, "python": languages.python, "go": languages.go,
    "rust": languages.rust, "dart": languages.dart, "prisma": languages.prisma, "sql": languages.sql, "java": languages.jvm, "kotlin": languages.jvm, "php": languages.php,
    "markdown": languages.markdown, "csharp": languages.c_style, "cpp": languages.c_style, "ruby": languages.c_style,
}
COLUMNS_NODE = ["id", "name", "kind", "file_path", "start_line", "end_line", "snippet", "signature", "docstring", "metadata"]
COLUMNS_EDGE = ["id", "source_id", "target_id", "target_name", "kind", "file_path", "line", "confidence", "metadata"]


def parse(path: str, content: str, language: str | None = None) -> Graph:
    """Nodes and edges of one file; a parser that fails leaves the file node alone."""
    language = language or schema.EXTENSIONS.get(path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower(), "unknown")
    content = content.replace("\r\n", "\n")

    def start() -> Graph:
        g = Graph(path, content)
        g.node("file", path.rsplit("/", 1)[-1], 1, len(g.lines), f"file:{path}", 1, language=language, sizeBytes=len(content.encode("utf-8", "surrogatepass")))
        row = list(g.nodes[f"file:{path}"])
        row[6], row[7] = content[:300], None
        g.nodes[f"file:{path}"] = tuple(row)
        return g

    g = start()
    if language in PARSERS:
        try:
            PARSERS[language](g)
        except Exception:
            g = start()
    return g


#: Files whose rows leave a parser's task together.
FILES_AT_ONCE = 500


def parsed(files: DataFrame, nodes: list[str] = COLUMNS_NODE, edges: list[str] = COLUMNS_EDGE, places: bool = True) -> DataFrame:
    """(node, edge) of files (path, content), parsed once: each row has one of the two structs, with the columns asked for; none of those without any. An id may come from several files; ``places`` tells which and where."""
    rows = files.select("path", "content", text.language(F.col("path")).alias("language"))
    ints = {"start_line", "end_line", "line", "emit_ord"}
    node, edge = ([*columns, *(["file_ord", "emit_ord"] if places else [])] for columns in (nodes, edges))
    node_at, edge_at = ([every.index(c) for c in columns] for every, columns in ((COLUMNS_NODE, nodes), (COLUMNS_EDGE, edges)))
    node_type, edge_type = (pa.struct([(c, pa.int32() if c in ints else pa.string()) for c in columns]) for columns in (node, edge))

    def structs(found: list[tuple[str, list[tuple]]], at: list[int], type_: pa.StructType) -> pa.StructArray:
        every = [row for _, rows in found for row in rows]
        columns = [[row[k] for row in every] for k in at]
        if places:
            columns += [[path for path, rows in found for _ in rows], [k for _, rows in found for k in range(len(rows))]]
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, type_, strict=True)], fields=list(type_))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, FILES_AT_ONCE) for whole in it for at in range(0, whole.num_rows, FILES_AT_ONCE)):
            graphs = [parse(path, content or "", language) for path, content, language in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            if node_at:
                found = structs([(g.path, list(g.nodes.values())) for g in graphs], node_at, node_type)
                yield pa.RecordBatch.from_arrays([found, pa.nulls(len(found), edge_type)], ["node", "edge"])
            if edge_at:
                found = structs([(g.path, list(g.edges.values())) for g in graphs], edge_at, edge_type)
                yield pa.RecordBatch.from_arrays([pa.nulls(len(found), node_type), found], ["node", "edge"])

    ddl = lambda columns: "struct<" + ", ".join(f"{c}: {'int' if c in ints else 'string'}" for c in columns) + ">"
    return rows.mapInArrow(batches, f"node {ddl(node)}, edge {ddl(edge)}")


def versions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed rows: all versions, one for each id and file."""
    return tuple(rows.where(f"{c} is not null").select(f"{c}.*") for c in ("node", "edge"))


def settled(rows: DataFrame) -> DataFrame:
    """One row per id of all its versions, ordered by path and place in the file."""
    return last_writer(rows).withColumn("ord", F.struct("file_ord", "emit_ord"))


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files (path, content), one row per id."""
    nodes, edges = versions(parsed(files))
    return settled(nodes), settled(edges)


def parse_nodes(files: DataFrame, *columns: str) -> DataFrame:
    """These columns of the nodes of ``parse_files``: nothing else leaves the parsers or is shuffled."""
    return settled(versions(parsed(files, ["id", *columns], []))[0]).select(*columns)


def parse_edges(files: DataFrame, *columns: str) -> DataFrame:
    """These columns of the edges of ``parse_files``, as ``parse_nodes``."""
    return settled(versions(parsed(files, [], ["id", *columns]))[1]).select(*columns)


def parse_apart(files: DataFrame, nodes: list[str], edges: list[str]) -> DataFrame:
    """(node, edge) with these columns of the rows of ``parse_files``, one of the two in each row, of files that share no id: each path comes once and their routes differ.
    A file's own rows are settled as it is parsed, so files are parsed once and nothing is shuffled."""
    return parsed(files, nodes, edges, places=False)


def file_rows(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The files table: path, hash, size, mtime_ms, language, node_count, edge_count."""
    n = nodes.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("node_count"))
    e = edges.groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("edge_count"))
    base = files.select("path", text.content_hash(F.coalesce("content", F.lit(""))).alias("hash"), "size", "mtime_ms", text.language(F.col("path")).alias("language"))
    return base.join(n, "path", "left").join(e, "path", "left").fillna(0, ["node_count", "edge_count"])
