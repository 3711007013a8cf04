"""Many seeds traversed together give what each gives alone."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import traverse
from quillgraph.plans import registry
from quillgraph.sources import star


def test_seeds_together_equal_seeds_alone(spark):
    rng = random.Random(6)
    ids = [f"n{i}" for i in range(160)]
    links = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(260)} | {(i, "n0") for i in ids[:70]})
    nodes = spark.createDataFrame([(i, i, rng.choice(["function", "route"]), rng.choice(["a.py", "b.py", "c.py", None]), k) for k, i in enumerate(ids)], "id string, name string, kind string, file_path string, ord long")
    edges = spark.createDataFrame([(a, b, None, "calls", "f", 1, k) for k, (a, b) in enumerate(links)], "source_id string, target_id string, target_name string, kind string, file_path string, line int, ord long")
    seeds = spark.createDataFrame([(f"s{i}", i) for i in ids] + [("two", "n0"), ("two", "n5"), ("gone", "sym:gone")], "seed string, id string")
    info = {r.id: r for r in nodes.collect()}
    back = {}
    for a, b in links:
        back.setdefault(b, set()).add(a)
    want = {}
    for label in {r.seed for r in seeds.collect()}:
        depth = {r.id: 0 for r in seeds.where(F.col("seed") == label).collect()} if label in ("two", "gone") else {label[1:]: 0}
        level = set(depth)
        for d in range(1, 4):
            level = {a for b in level for a in back.get(b, ())} - set(depth)
            depth |= dict.fromkeys(level, d)
        n = Counter("direct" if d == 1 else "further" if d > 1 else "own" for d in depth.values())
        known = [info[i] for i in depth if i in info]
        want[label] = (n["direct"], n["further"], len({r.file_path for r in known if r.file_path}), sum(r.kind == "route" and depth[r.id] > 0 for r in known))
    got = {r.seed: (r.direct_callers, r.transitive_callers, r.affected_files, r.affected_routes) for r in traverse.impact(nodes, edges, seeds, 3).collect()}
    assert got == want
    numbers = traverse.numbered(seeds)
    assert numbers.select("word", "bit").distinct().count() == numbers.count() == len(want)


def star_tables(spark, folder):
    """A small star with orders that are missing, keys that are null or repeated and customers of no nation."""
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "EUROPE"), (1, "ASIA")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "A", 0), (1, "B", 0), (2, "C", 1), (3, "D", None)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int", [(k, f"Customer#{k % 9}", [0, 1, 2, 3, None, 77][k % 6]) for k in range(30)] + [(5, "Customer#5", 0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(k, f"S{k}", k % 5) for k in range(8)]),
        "part": ("p_partkey long, p_name string, p_brand string", [(k, f"P{k}", "b") for k in range(5)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderpriority string", [(k, [k % 40, None][k % 11 == 0], ["1-URGENT", "5-LOW"][k % 2]) for k in range(60)]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [((k * 7) % 90, k % 6, [k % 10, None][k % 13 == 0], k % 4) for k in range(150)]),
    }
    for name, (ddl, rows) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_steps_by_the_tables_keys_equal_steps_along_all_edges(spark, tmp_path, monkeypatch):
    d = star_tables(spark, tmp_path)
    g, nodes, edges = star.Star(spark, d), star.nodes(spark, d), star.edges(spark, d)
    ids = ["region:0", "region:1", "nation:2", "nation:77", "supplier:3", "supplier:9", "customer:5", "customer:05", "order:70", "part:5", "sym:gone", "gone"]
    seeds = spark.createDataFrame([(f"s{i}", i) for i in ids] + [("two", "nation:0"), ("two", "customer:4"), ("none", None)], "seed string, id string")
    for broadcast in (star.BROADCAST_KEYS, 0):
        monkeypatch.setattr(star, "BROADCAST_KEYS", broadcast)
        both = [sorted(map(str, traverse.impact(*graph, seeds, 5).collect())) for graph in ((g, g), (nodes, edges))]
        assert both[0] == both[1] and len(both[0]) == len(ids) + 2
        both = [sorted(map(str, traverse.impact_levels(*graph, seeds, 5).collect())) for graph in ((g, g), (nodes, edges))]
        assert both[0] == both[1]


@pytest.mark.parametrize("name", ["audit_gate_multi", "impact_levels"])
def test_registered_traversals_write_no_table_of_all_steps(spark, tmp_path, monkeypatch, name):
    kept = []
    monkeypatch.setattr(traverse, "checkpoint", lambda df, real=traverse.checkpoint: (kept.append(df.columns), real(df))[1])
    assert registry.QUERIES[name](spark, star_tables(spark, tmp_path)).count() and kept
    assert not any("at" in columns for columns in kept)
