"""The star schema's tables as a graph: every operator can run on relational data.

The statements are plain SQL over {table} placeholders, so a second engine can read the same graph.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NODES = {
    "region": "SELECT 'region:' || r_regionkey AS id, r_name AS name, 'file' AS kind, 'region/' || r_regionkey AS file_path, CAST(r_regionkey AS BIGINT) AS ord FROM {region}",
    "nation": "SELECT 'nation:' || n_nationkey AS id, n_name AS name, 'class' AS kind, 'region/' || n_regionkey AS file_path, 1000000000000 + n_nationkey AS ord FROM {nation}",
    "customer": "SELECT 'customer:' || c_custkey AS id, c_name AS name, 'function' AS kind, 'nation/' || c_nationkey AS file_path, 2000000000000 + c_custkey AS ord FROM {customer}",
    "supplier": "SELECT 'supplier:' || s_suppkey AS id, s_name AS name, 'interface' AS kind, 'nation/' || s_nationkey AS file_path, 3000000000000 + s_suppkey AS ord FROM {supplier}",
    "part": "SELECT 'part:' || p_partkey AS id, p_name AS name, 'type' AS kind, 'brand/' || p_brand AS file_path, 4000000000000 + p_partkey AS ord FROM {part}",
    "orders": "SELECT 'order:' || o_orderkey AS id, 'order_' || o_orderkey AS name, CASE WHEN o_orderpriority = '1-URGENT' THEN 'route' ELSE 'method' END AS kind, 'customer/' || o_custkey AS file_path, 5000000000000 + o_orderkey AS ord FROM {orders}",
    "documents": "SELECT 'doc:' || doc_id AS id, 'doc_' || doc_id AS name, 'doc_section' AS kind, source AS file_path, 6000000000000 + doc_id AS ord FROM {documents}",
}


def _edge(kind: str, source: tuple[str, str], target: tuple[str, str], path: str, table: str, key: str, rank: int, line: str = "1") -> tuple[tuple[str, str], tuple[str, str], str]:
    """(source, target, statement); an end is (type, key column)."""
    id_ = lambda end: f"'{end[0]}:' || {end[1]}"
    return source, target, f"SELECT {id_(source)} AS source_id, {id_(target)} AS target_id, '{kind}' AS kind, {path} AS file_path, CAST({line} AS INT) AS line, {rank} * 1000000000000 + {key} AS ord FROM {{{table}}}"


_REGION, _NATION = ("region", "n_regionkey"), ("nation", "n_nationkey")
_EDGES = {
    "nation": [_edge("imports", _NATION, _REGION, "'region/' || n_regionkey", "nation", "n_nationkey", 1), _edge("contains", _REGION, _NATION, "'region/' || n_regionkey", "nation", "n_nationkey", 2)],
    "customer": [
        _edge("references", ("customer", "c_custkey"), ("nation", "c_nationkey"), "'nation/' || c_nationkey", "customer", "c_custkey", 3),
        _edge("contains", ("nation", "c_nationkey"), ("customer", "c_custkey"), "'nation/' || c_nationkey", "customer", "c_custkey", 4),
    ],
    "supplier": [
        _edge("references", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "'nation/' || s_nationkey", "supplier", "s_suppkey", 5),
        _edge("contains", ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "'nation/' || s_nationkey", "supplier", "s_suppkey", 6),
    ],
    "orders": [_edge("calls", ("order", "o_orderkey"), ("customer", "o_custkey"), "'customer/' || o_custkey", "orders", "o_orderkey", 7)],
    "lineitem": [
        _edge("references", ("order", "l_orderkey"), ("supplier", "l_suppkey"), "'order/' || l_orderkey", "lineitem", "l_orderkey * 100 + l_linenumber", 8, "l_linenumber"),
        _edge("references", ("order", "l_orderkey"), ("part", "l_partkey"), "'order/' || l_orderkey", "lineitem", "l_orderkey * 100 + l_linenumber", 9, "l_linenumber"),
    ],
}
#: Type and key column of each table's nodes.
_KEYS = {"region": ("region", "r_regionkey"), "nation": ("nation", "n_nationkey"), "customer": ("customer", "c_custkey"), "supplier": ("supplier", "s_suppkey"), "part": ("part", "p_partkey"), "orders": ("order", "o_orderkey"), "documents": ("doc", "doc_id")}
ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def nodes_sql(tables: list[str] = ALL) -> str:
    return "\nUNION ALL ".join(_NODES[t] for t in tables if t in _NODES)


def edges_sql(tables: list[str] = ALL) -> str:
    return "\nUNION ALL ".join(sql for t in tables for _, _, sql in _EDGES.get(t, []))


def plain(sql: str) -> str:
    """The statement over tables of the same names, for an engine that has them as views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(sql, **frames)


def nodes(spark: SparkSession, sf_dir: str, tables: list[str] = ALL) -> DataFrame:
    """id, name, kind, file_path, ord."""
    return _run(spark, sf_dir, nodes_sql(tables))


def edges(spark: SparkSession, sf_dir: str, tables: list[str] = ALL) -> DataFrame:
    """source_id, target_id, kind, file_path, line, ord; a multigraph."""
    return _run(spark, sf_dir, edges_sql(tables))


#: Keys that may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 500_000


class Star:
    """The graph by its typed keys: what lies at given ids, found by the tables' own key columns, so that filters and joins on them reach the files.

    ``ids`` is one id or a frame with a column ``id``.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, tables: list[str] = ALL):
        self.spark, self.tables = spark, tables
        self._frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}

    def _all(self, wanted: list[tuple[str, tuple[str, str], str]], ids: str | DataFrame, empty: str) -> DataFrame:
        """The statements (table, end, sql) over the rows of their tables whose ``end`` is among the ids."""
        found = []
        if isinstance(ids, str):
            kind, _, key = ids.partition(":")
            for table, end, sql in wanted:
                if kind == end[0] and key.isdigit():
                    found.append(self.spark.sql(sql, **{table: self._frames[table].where(F.col(end[1]) == int(key))}))
        else:
            typed = ids.select(F.substring_index("id", ":", 1).alias("kind"), F.expr("try_cast(substring_index(id, ':', -1) AS BIGINT)").alias("__key"))
            sizes = {r.kind: r["count"] for r in typed.where(F.col("kind").isin([k for k, _ in _KEYS.values()])).groupBy("kind").count().collect()}  # one row for each type
            for table, end, sql in wanted:
                if end[0] in sizes:
                    keys = typed.where(F.col("kind") == end[0]).select("__key").distinct()
                    side = F.broadcast(keys) if sizes[end[0]] <= BROADCAST_KEYS else keys
                    found.append(self.spark.sql(sql, **{table: self._frames[table].join(side, F.col(end[1]) == F.col("__key"), "left_semi")}))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], empty)

    def nodes(self, ids: str | DataFrame) -> DataFrame:
        """id, name, kind, file_path, ord of the ids that are nodes."""
        return self._all([(t, _KEYS[t], _NODES[t]) for t in self.tables if t in _NODES], ids, "id string, name string, kind string, file_path string, ord bigint")

    def edges(self, ids: str | DataFrame, side: str, kinds: list[str] | None = None) -> DataFrame:
        """The edges whose ``side`` (source_id or target_id) is among the ids."""
        at = 0 if side == "source_id" else 1
        wanted = [(t, e) for t in self.tables for e in _EDGES.get(t, []) if kinds is None or any(f"'{k}' AS kind" in e[2] for k in kinds)]
        return self._all([(t, e[at], e[2]) for t, e in wanted], ids, "source_id string, target_id string, kind string, file_path string, line int, ord bigint")

    def _typed(self, rows: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """``rows`` (id and more) whose id may be a node's, with its type and key (__type, __key) before the id, and how many there are of each type."""
        typed = rows.select(F.substring_index("id", ":", 1).alias("__type"), F.expr("try_cast(substring_index(id, ':', -1) AS BIGINT)").alias("__key"), *rows.columns)
        typed = typed.where(F.col("__type").isin([_KEYS[t][0] for t in self.tables if t in _KEYS]) & (F.col("id") == F.concat_ws(":", "__type", F.col("__key").cast("string"))))
        return typed, {r[0]: r[1] for r in typed.groupBy("__type").count().collect()}  # one row for each type

    def follow(self, rows: DataFrame, side: str, kinds: list[str], known: bool) -> DataFrame | None:
        """``rows`` (id and more) with the ids at the other end of the edges whose ``side`` is their id, nodes or not; None if no edge can be at any of them. ``known``: only from ids that are nodes."""
        at = 0 if side == "source_id" else 1
        typed, sizes = self._typed(rows)
        rest, tables, found = [c for c in rows.columns if c != "id"], {_KEYS[t][0]: (t, _KEYS[t][1]) for t in self.tables if t in _KEYS}, []
        for table in self.tables:
            for edge in _EDGES.get(table, []):
                (kind, key), (other, other_key) = edge[at], edge[1 - at]
                if kind not in sizes or not any(f"'{k}' AS kind" in edge[2] for k in kinds):
                    continue
                few = F.broadcast if sizes[kind] <= BROADCAST_KEYS else lambda df: df
                own = typed.where(F.col("__type") == kind).select("__key", *rest)
                if known:
                    home, home_key = tables[kind]
                    own = self._frames[home].select(F.col(home_key).cast("long").alias("__key")).join(few(own), "__key")
                ends = self._frames[table].select(F.col(key).cast("long").alias("__key"), F.concat(F.lit(f"{other}:"), F.col(other_key).cast("string")).alias("id"))
                found.append(ends.join(few(own), "__key").select("id", *rest))
        return reduce(DataFrame.unionByName, found) if found else None

    def described(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, depth and more) with kind and file_path, without those that are no nodes; rows of depth 0 stay all the same."""
        typed, sizes = self._typed(rows)
        home = [t for t in self.tables if t in _KEYS and _KEYS[t][0] in sizes]
        if not home:
            return rows.where("depth = 0").withColumns({"kind": F.lit(None).cast("string"), "file_path": F.lit(None).cast("string")})
        own = [self.spark.sql(f"SELECT '{_KEYS[t][0]}' AS __type, CAST({_KEYS[t][1]} AS BIGINT) AS __key, kind, file_path FROM ({_NODES[t].replace('SELECT ', f'SELECT {_KEYS[t][1]}, ', 1)})", **{t: self._frames[t]}) for t in home]
        nodes = reduce(DataFrame.unionByName, own)
        few = F.broadcast if sum(sizes.values()) <= BROADCAST_KEYS else lambda df: df
        found = nodes.join(few(typed), ["__key", "__type"]).select(*rows.columns, "kind", "file_path")
        first = rows.where("depth = 0")
        lost = first.join(self.nodes(first).select("id"), "id", "left_anti").select(*rows.columns, F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("file_path"))
        return found.unionByName(lost)
