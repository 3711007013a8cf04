"""Neighbourhoods and reachability: explore, impact, audit, forward flow, blast radius.

Traversals run level by level on the driver's loop: each level is an equi-join of the frontier with the edges and one
aggregation of what it finds together with the visited set, then a checkpoint. Depth is bounded by the caller. Many
targets are traversed at once by keying every row with its seed.

``nodes`` and ``edges`` are frames, or a source that finds those at given ids by its own keys: ``nodes(ids)`` and
``edges(ids, side, kinds)``, with ids one id or a frame with a column id. Impact also takes the source itself for both
(``follow`` and ``described``): then rows take a step by its keys, and only edges that can be at a frontier are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.functions import text
from quillgraph.functions.frames import checkpoint, first_by
from quillgraph.operators.resolve import seed

Nodes = DataFrame | Callable[..., DataFrame]
Edges = DataFrame | Callable[..., DataFrame]


def edges_at(edges: Edges, ids: str | DataFrame, side: str, kinds: list[str]) -> DataFrame:
    """The edges of some kinds whose ``side`` is among the ids."""
    if not isinstance(edges, DataFrame):
        return edges(ids, side, kinds)
    rows = edges.where(F.col("kind").isin(kinds))
    return rows.where(F.col(side) == ids) if isinstance(ids, str) else rows.join(ids.select(F.col("id").alias("__id")).distinct(), F.col(side) == F.col("__id"), "left_semi")


def nodes_at(nodes: Nodes, ids: DataFrame) -> DataFrame:
    """The nodes among the ids."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi") if isinstance(nodes, DataFrame) else nodes(ids)


def reach(seeds: DataFrame, steps: DataFrame | Callable[[DataFrame, int], DataFrame | None], depth: int) -> DataFrame:
    """(seed, id, depth) of everything within ``depth`` steps of each seed, itself at depth 0. ``steps``: (at, to), or what takes rows (id and more) of a level one step on."""
    seen = checkpoint(seeds.select("seed", "id", F.lit(0).alias("depth")).distinct())
    if isinstance(steps, DataFrame):
        steps = _along(checkpoint(steps.select("at", "to")))  # written once, read at each level
    frontier = seen
    for level in range(1, depth + 1):
        near = steps(frontier.select("seed", "id"), level)
        if near is None:
            break
        both = seen.unionByName(near.select("seed", "id", F.lit(level).alias("depth")))
        frontier = checkpoint(both.groupBy("seed", "id").agg(F.min("depth").alias("depth")).where(F.col("depth") == level))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _along(near: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """What takes rows along steps (at, to)."""
    return lambda rows, level: rows.join(near, F.col("id") == F.col("at")).select(F.col("to").alias("id"), *[c for c in rows.columns if c != "id"])


def impact_levels(nodes: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """(seed, id, depth, kind, file_path): nodes that a change of each target's node reaches. ``targets``: (seed, id)."""
    found = reach(targets, _steps(nodes, edges, "target_id", "source_id", schema.IMPACT_KINDS), depth)
    return _described(nodes, found).select("seed", "id", "depth", "kind", "file_path")


def _described(nodes: Nodes, found: DataFrame) -> DataFrame:
    """What was found with its kind and file_path."""
    return nodes.described(found) if hasattr(nodes, "described") else found.join(nodes_at(nodes, found).select("id", "kind", "file_path"), "id", "left")


def _steps(nodes: Nodes, edges: Edges, own: str, other: str, kinds: list[str]) -> DataFrame | Callable[[DataFrame, int], DataFrame | None]:
    """Steps from ``own`` to ``other`` ends that are nodes: all, or what takes a frontier's rows along them where a source finds edges by id."""
    if hasattr(edges, "follow"):
        return lambda rows, level: edges.follow(rows, own, kinds, level > 1)
    if isinstance(edges, DataFrame):
        rows = edges.where(F.col("kind").isin(kinds)).select(F.col(own).alias("at"), F.col(other).alias("to"))
        return rows.join(nodes.select(F.col("id").alias("to")), "to", "left_semi")

    def near(ids: DataFrame) -> DataFrame:
        rows = checkpoint(edges(ids, own, kinds).select(F.col(own).alias("at"), F.col(other).alias("to")).distinct())
        return rows.join(nodes_at(nodes, rows.select(F.col("to").alias("id"))).select(F.col("id").alias("to")), "to", "left_semi")

    return lambda rows, level: _along(near(rows.select("id").distinct()))(rows, level)


def numbered(seeds: DataFrame) -> DataFrame:
    """(seed, word, bit) of each seed: 64 seeds to a word, those whose nodes are next to each other by id in the same one."""
    order = seeds.groupBy("seed").agg(F.min("id").alias("first")).repartitionByRange("first").sortWithinPartitions("first")
    n = F.monotonically_increasing_id()
    return checkpoint(order.select("seed", n.alias("n"))).select("seed", F.shiftright("n", 6).alias("word"), F.col("n").bitwiseAND(F.lit(63)).cast("int").alias("bit"))


def reach_together(seeds: DataFrame, numbers: DataFrame, steps: DataFrame | Callable[[DataFrame, int], DataFrame | None], depth: int) -> DataFrame:
    """(id, word, bits, depth): ``reach`` of many seeds at once, a row for 64 of them: the set bits are the seeds that find the id at that depth."""
    first = seeds.select("seed", "id").join(numbers, "seed").groupBy("id", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    found = checkpoint(first.withColumn("depth", F.lit(0)))
    if isinstance(steps, DataFrame):
        steps = _along(checkpoint(steps.select("at", "to").distinct()))
    frontier = found
    for level in range(1, depth + 1):
        near = steps(frontier.select("id", "word", "bits"), level)
        if near is None:
            break
        both = near.select("id", "word", "bits", F.lit(0).cast("long").alias("seen")).unionByName(found.select("id", "word", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("seen")))
        new = both.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("seen").alias("seen"))
        frontier = checkpoint(new.select("id", "word", F.col("bits").bitwiseAND(F.bitwise_not("seen")).alias("bits"), F.lit(level).alias("depth")).where("bits <> 0"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def _per_seed(rows: DataFrame, numbers: DataFrame, *counts: str) -> DataFrame:
    """Sums of counts by seed, of rows (word, bits, counts): equal sets of seeds are summed before they are taken apart."""
    sums = rows.groupBy("word", "bits").agg(*[F.sum(c).alias(c) for c in counts])
    apart = sums.withColumn("bit", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1) = 1)")))
    return apart.groupBy("word", "bit").agg(*[F.sum(c).alias(c) for c in counts]).join(numbers, ["word", "bit"]).select("seed", *counts)


def impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 5) -> DataFrame:
    """One row per target: callers, files, routes, risk and summary."""
    numbers = numbered(targets)
    found = reach_together(targets, numbers, _steps(nodes, edges, "target_id", "source_id", schema.IMPACT_KINDS), depth)
    rows = checkpoint(_described(nodes, found).select("word", "bits", "depth", "kind", "file_path"))
    one = lambda test: F.when(test, 1).otherwise(0)
    callers = rows.select("word", "bits", one(F.col("depth") == 1).alias("direct_callers"), one(F.col("depth") > 1).alias("transitive_callers"), one((F.col("depth") > 0) & (F.col("kind") == "route")).alias("affected_routes"))
    files = rows.where("file_path is not null").groupBy("word", "file_path").agg(F.bit_or("bits").alias("bits")).select("word", "bits", F.lit(1).alias("affected_files"))
    n = _per_seed(callers, numbers, "direct_callers", "transitive_callers", "affected_routes").join(_per_seed(files, numbers, "affected_files"), "seed", "left").fillna(0, ["affected_files"])
    n = n.select("seed", "direct_callers", "transitive_callers", "affected_files", "affected_routes")
    n = n.withColumn("risk", text.risk(F.col("direct_callers") + F.col("transitive_callers"), F.col("affected_files"), F.col("affected_routes")))
    said = F.format_string(
        "Changing '%s' impacts %d direct caller(s), %d transitive caller(s) across %d file(s), and %d HTTP route(s). Risk Level: %s.",
        "seed", "direct_callers", "transitive_callers", "affected_files", "affected_routes", "risk",
    )
    return n.withColumn("summary", said)


def impact_of(nodes: DataFrame, edges: DataFrame, target: str, depth: int = 5) -> DataFrame:
    one = SparkSession.active().createDataFrame([(target, seed(nodes, target) if isinstance(nodes, DataFrame) else target)], "seed string, id string")
    return impact(nodes, edges, one, depth)


def audit(nodes: DataFrame, edges: DataFrame, targets: DataFrame, max_risk: str = "HIGH", depth: int = 5) -> DataFrame:
    """The gate: seed, risk, passed."""
    rows = impact(nodes, edges, targets, depth)
    return rows.select("seed", "risk", (text.risk_rank(F.col("risk")) <= text.risk_rank(F.lit(max_risk))).alias("passed"))


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str, side: str) -> DataFrame:
    """Callers or callees of a node, each by its first edge: id, name, kind, file_path, edge_kind, line."""
    own, other = ("target_id", "source_id") if side == "callers" else ("source_id", "target_id")
    rows = edges_at(edges, node_id, own, schema.CALL_KINDS).select(F.col(other).alias("id"), F.col("kind").alias("edge_kind"), "line", F.col("ord").alias("edge_ord"))
    near = first_by(rows, ["id"], [F.col("edge_ord")])
    return near.join(nodes_at(nodes, near), "id").select("id", "name", "kind", "file_path", "edge_kind", "line")


def call_paths(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """(source_id, target_id, edge_kind, line) of a node's callers and callees."""
    inward = neighbours(nodes, edges, node_id, "callers").select(F.col("id").alias("source_id"), F.lit(node_id).alias("target_id"), "edge_kind", "line")
    outward = neighbours(nodes, edges, node_id, "callees").select(F.lit(node_id).alias("source_id"), F.col("id").alias("target_id"), "edge_kind", "line")
    return inward.unionByName(outward)


def related_docs(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    rows = edges_at(edges, node_id, "target_id", ["documents"]).select(F.col("source_id").alias("id"))
    return rows.join(nodes_at(nodes, rows), "id").select("id", "name", "kind", "file_path")


def forward_flow(nodes: DataFrame, edges: DataFrame, entry_id: str, depth: int = 3) -> DataFrame:
    """(id, depth, parent_id): what an entry reaches along calls and references, with the tree edge that found it first."""
    one = SparkSession.active().createDataFrame([("entry", entry_id)], "seed string, id string")
    levels = checkpoint(reach(one, _steps(nodes, edges, "source_id", "target_id", schema.CALL_KINDS), depth).select("id", "depth"))
    use = edges_at(edges, levels.where(F.col("depth") < depth), "source_id", schema.CALL_KINDS)
    parents = levels.select(F.col("id").alias("parent_id"), (F.col("depth") + 1).alias("depth"))
    found = levels.join(use.select(F.col("target_id").alias("id"), F.col("source_id").alias("parent_id"), F.col("ord").alias("edge_ord")), "id").join(parents, ["parent_id", "depth"])
    tree = found.groupBy("id").agg(F.min_by("parent_id", F.struct("edge_ord", "parent_id")).alias("parent_id"))
    return levels.join(tree, "id", "left").select("id", "depth", "parent_id")


def blast_radius(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """One step over all kinds of edges, callers counted once per edge: callers, routes, risk."""
    rows = edges_at(edges, node_id, "target_id", schema.EDGE_KINDS).select(F.col("source_id").alias("id"))
    rows = rows.join(nodes_at(nodes, rows).select("id", "kind"), "id")
    n = rows.agg(F.count(F.lit(1)).alias("callers"), F.count_if(F.col("kind") == "route").alias("routes"))
    return n.withColumn("risk", F.when((F.col("routes") > 0) | (F.col("callers") > 10), "CRITICAL").when(F.col("callers") > 5, "HIGH").when(F.col("callers") > 0, "MEDIUM").otherwise("LOW"))


def surgical_context(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """(side, id, name, line) along calls only, one row per edge."""
    inward = edges_at(edges, node_id, "target_id", ["calls"]).select(F.lit("caller").alias("side"), F.col("source_id").alias("id"), "line")
    outward = edges_at(edges, node_id, "source_id", ["calls"]).select(F.lit("callee").alias("side"), F.col("target_id").alias("id"), "line")
    both = inward.unionByName(outward)
    return both.join(nodes_at(nodes, both).select("id", "name"), "id").select("side", "id", "name", "line")
