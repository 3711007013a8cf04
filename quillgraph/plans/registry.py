"""Every query of the engine over the driver's tables, with the SQL that a second engine checks it by."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import schema
from quillgraph.functions import text
from quillgraph.functions.frames import last_writer
from quillgraph.operators import fresh, metrics, resolve, search, traverse
from quillgraph.sources import star

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _graph(tables=star.ALL) -> str:
    return f"WITH RECURSIVE nodes AS ({star.plain(star.nodes_sql(tables))}), edges AS ({star.plain(star.edges_sql(tables))})"


G = _graph()

# --- scan and parse functions over tables ---------------------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return _table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS lines, substr(text, 1, 300) AS snippet, strlen(text) AS size FROM documents")
def file_row(spark, d):
    t = _table(spark, d, "documents")
    return t.select("doc_id", text.line_count(F.col("text")).cast("long").alias("lines"), F.substring("text", 1, 300).alias("snippet"), F.octet_length("text").cast("long").alias("size"))


@query("SELECT doc_id, CAST(length(substr(text, 1, p)) - length(replace(substr(text, 1, p), chr(10), '')) + 1 AS BIGINT) AS line FROM (SELECT doc_id, text, length(text) // 2 AS p FROM documents)")
def line_number(spark, d):
    """The line of the character in the middle of each text."""
    t = _table(spark, d, "documents")
    return t.select("doc_id", text.line_of(F.col("text"), F.floor(F.length("text") / 2).cast("int")).cast("long").alias("line"))


_LANGS = "(VALUES " + ", ".join(f"('{e}', '{v}')" for e, v in sorted(schema.EXTENSIONS.items())) + ") AS l(ext, lang)"
_PATH = "regexp_replace(url, '[?#].*$', '')"


@query(f"SELECT page_id, coalesce(l.lang, 'unknown') AS language FROM (SELECT page_id, lower(regexp_extract(string_split({_PATH}, '/')[-1], '^.+\\.([^.]+)$', 1)) AS ext FROM pages) p LEFT JOIN {_LANGS} ON p.ext = l.ext")
def lang_detect(spark, d):
    return _table(spark, d, "pages").select("page_id", text.language(F.regexp_replace("url", "[?#].*$", "")).alias("language"))


def _paths(spark, d):
    return _table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), F.element_at(F.array(*[F.lit(x) for x in _TAILS]), (F.col("p_partkey") % len(_TAILS) + 1).cast("int"))).alias("path"))


_TAILS = ["node_modules/a.ts", "src/b.py", "x.min.js", ".git/config", "key.pem", ".env", ".env.local", "id_rsa", "yarn.lock", "c.go", "Secrets.yaml", "out.map", "KNOWLEDGE_BASE.md"]
_PATHS = "(SELECT p_partkey, replace(p_type, ' ', '/') || '/' || [" + ", ".join(f"'{x}'" for x in _TAILS) + f"][p_partkey % {len(_TAILS)} + 1] AS path FROM part)"


@query(f"SELECT p_partkey, path, (len(list_intersect(string_split(path, '/'), [{', '.join(repr(s) for s in schema.IGNORED_SEGMENTS)}])) > 0 OR " + " OR ".join(f"ends_with(lower(path), '{s}')" for s in schema.IGNORED_SUFFIXES) + f") AS ignored FROM {_PATHS}")
def ignore_filter(spark, d):
    return _paths(spark, d).select("p_partkey", "path", text.ignored(F.col("path")).alias("ignored"))


@query(f"SELECT p_partkey, ({' OR '.join(f'regexp_matches(lower(b), \'{p}\')' for p in schema.SECRET_NAMES)}) AS secret FROM (SELECT p_partkey, string_split(path, '/')[-1] AS b FROM {_PATHS})")
def secret_filter(spark, d):
    return _paths(spark, d).select("p_partkey", text.secret_file(F.col("path")).alias("secret"))


@query("SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '(?:\\.|\\b)([A-Za-z0-9_$]+)\\s*\\(', 1), lambda x: NOT list_contains([" + ", ".join(f"'{w}'" for w in "if for while switch catch require import return console log error warn info typeof sizeof new def class func fn lambda struct".split()) + "], x)))) AS callee FROM documents")
def regex_calls(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.explode(text.calls(F.col("text"))).alias("callee"))


@query("SELECT page_id, CAST(sum(len(s)) AS BIGINT) AS script_chars, count(*) AS scripts FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS s FROM pages) GROUP BY page_id")
def sfc_scripts(spark, d):
    t = _table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("s"))
    return t.groupBy("page_id").agg(F.sum(F.length("s")).alias("script_chars"), F.count(F.lit(1)).alias("scripts"))


@query("SELECT doc_id, CAST(ceil(length(text) / 3.8) AS BIGINT) AS tokens FROM documents")
def token_cost(spark, d):
    return _table(spark, d, "documents").select("doc_id", text.token_cost(F.col("text")).alias("tokens"))


@query("""SELECT source, CAST(sum(ceil(length(text) / 3.75)) AS BIGINT) AS whole, CAST(sum(ceil(length(substr(text, 1, 300)) / 3.75)) AS BIGINT) AS part,
round((1 - sum(ceil(length(substr(text, 1, 300)) / 3.75)) / sum(ceil(length(text) / 3.75))) * 100, 2) AS saved FROM documents GROUP BY source""")
def token_savings(spark, d):
    """Tokens of whole texts and of the snippets that an answer shows, by source."""
    t = _table(spark, d, "documents").select("source", text.token_cost(F.col("text"), 3.75).alias("whole"), text.token_cost(F.substring("text", 1, 300), 3.75).alias("part"))
    n = t.groupBy("source").agg(F.sum("whole").alias("whole"), F.sum("part").alias("part"))
    return n.withColumn("saved", text.savings(F.col("part"), F.col("whole")))


def _tokens(x: str) -> str:
    """DuckDB list of a name's tokens."""
    split = "string_split(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), ' ')"
    segs = f"list_filter(string_split_regex(trim({x}), '[^a-zA-Z0-9]+'), lambda s: s <> '')"
    words = f"flatten(list_transform({segs}, lambda s: list_concat([lower(s)], list_transform({split}, lambda w: lower(w)))))"
    return f"list_distinct(list_filter(list_append({words}, lower(regexp_replace(trim({x}), '[^a-zA-Z0-9]', '', 'g'))), lambda w: length(w) BETWEEN 2 AND 50))"


@query(f"SELECT p_partkey, unnest({_tokens('n')}) AS token FROM (SELECT p_partkey, replace(p_name, ' ', 'X') || 'HTTPServer_' || p_brand AS n FROM part)")
def tokenize_symbol(spark, d):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("X")), F.lit("HTTPServer_"), F.col("p_brand"))
    return _table(spark, d, "part").select("p_partkey", F.explode(text.symbol_tokens(name)).alias("token"))


@query(f"{G} SELECT token, id, count(*) AS freq FROM (SELECT id, unnest({_tokens('name')}) AS token FROM nodes UNION ALL SELECT id, unnest({_tokens('file_path')}) FROM nodes) GROUP BY token, id")
def token_index(spark, d):
    return search.token_index(star.nodes(spark, d))


# --- search and lookup ----------------------------------------------------------------------------------------------


def _search_sql(q: str, limit: int, wanted: list[str]) -> str:
    terms = [t.lower() for t in q.split()]
    long = [q.lower(), *[t for t in terms if len(t) >= 2]]
    any_ = lambda f, ts: "(" + " OR ".join(f.format(t=t) for t in ts) + ")"
    exact = any_("name = '{t}'", [q, *q.split()])
    same = any_("lower(name) = '{t}'", [q.lower(), *terms])
    wanted = str(wanted)
    return f"""{G}, s AS (SELECT *, CASE WHEN {exact} THEN 100 WHEN {same} THEN 60 WHEN {any_("starts_with(lower(name), '{t}')", long)} THEN 30 WHEN {any_("contains(lower(name), '{t}')", long)} THEN 15 ELSE 0 END AS sym,
    5 * (len(list_filter({_tokens('name')}, lambda t: list_contains({wanted}, t))) + len(list_filter({_tokens('file_path')}, lambda t: list_contains({wanted}, t)))) AS tok FROM nodes)
    SELECT id, name, kind, file_path, CAST(sym + tok + CASE kind WHEN 'class' THEN 15 WHEN 'interface' THEN 15 WHEN 'route' THEN 12 WHEN 'function' THEN 10 WHEN 'method' THEN 10 WHEN 'type' THEN 8 ELSE 0 END
    + CASE WHEN {any_("contains(lower(file_path), '{t}')", long)} THEN 10 ELSE 0 END AS INT) AS score, CASE WHEN sym >= 60 THEN 'exact_name' WHEN sym > 0 THEN 'partial_name' ELSE 'fts_content' END AS match_type, name AS highlight
    FROM s WHERE sym + tok > 0 ORDER BY score DESC, name, ord LIMIT {limit}"""


#: Query -> its tokens, stated by hand for the second engine.
_ASKED = [
    ("search_exact", "Customer#000000007", 10, ["customer", "000000007"]), ("search_multi", "supplier 000000003", 20, ["supplier", "000000003"]),
    ("search_token", "000000011 region", 10, ["000000011", "region"]), ("search_part", "order_10", 20, ["order", "10", "order10"]),
]
for _name, _q, _n, _w in _ASKED:
    query(_search_sql(_q, _n, _w), _name)(lambda spark, d, q=_q, n=_n: search.search(star.nodes(spark, d), q, n))


@query(f"{G} SELECT id, name, kind FROM nodes WHERE lower(name) = 'customer#000000005'")
def find_by_name(spark, d):
    return resolve.find_by_name(star.nodes(spark, d), "CUSTOMER#000000005").select("id", "name", "kind")


_SYMBOLIC = "SELECT 'line:' || l_orderkey || ':' || l_linenumber AS id, 'order:' || l_orderkey AS source_id, CASE l_linenumber % 4 WHEN 0 THEN 'sym:no such ' || l_partkey WHEN 1 THEN 'pkg:' || l_suppkey ELSE 'sym:' || upper(p_name) END AS target_id, CAST(NULL AS STRING) AS target_name, 'calls' AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'brand/' || p_brand ELSE 'brand/none' END AS file_path FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"


@query(f"""{G}, sym AS ({star.plain(_SYMBOLIC).replace('AS STRING', 'AS VARCHAR')}),
named AS (SELECT lower(name) AS key, id, file_path, ord FROM nodes WHERE kind NOT IN ('file', 'doc_document')),
anywhere AS (SELECT key, count(*) AS n, arg_min(id, ord) AS first FROM named GROUP BY key),
own AS (SELECT key, file_path, arg_min(id, ord) AS first FROM named GROUP BY key, file_path),
raw AS (SELECT *, CASE WHEN starts_with(target_id, 'sym:') THEN substr(target_id, 5) END AS r FROM sym)
SELECT raw.id, source_id, CASE WHEN a.n = 1 THEN a.first WHEN a.n > 1 THEN coalesce(o.first, a.first) WHEN r IS NOT NULL THEN 'sym:' || r ELSE target_id END AS target_id,
CASE WHEN a.n = 1 OR (a.n > 1 AND o.first IS NOT NULL) THEN 'exact' WHEN a.n > 1 THEN 'heuristic' END AS confidence
FROM raw LEFT JOIN anywhere a ON a.key = lower(r) LEFT JOIN own o ON o.key = lower(r) AND o.file_path = raw.file_path""")
def resolve_refs(spark, d):
    return resolve.resolve(star.nodes(spark, d), star._run(spark, d, _SYMBOLIC)).select("id", "source_id", "target_id", "confidence")


# --- neighbourhoods and impact --------------------------------------------------------------------------------------

_NODE = "supplier:1"


def _near_sql(own: str, other: str, node: str) -> str:
    return f"SELECT n.id, n.name, n.kind, n.file_path, e.edge_kind, e.line FROM (SELECT {other} AS id, arg_min(kind, ord) AS edge_kind, arg_min(line, ord) AS line FROM edges WHERE {own} = '{node}' AND kind IN ('calls', 'references') GROUP BY {other}) e JOIN nodes n ON n.id = e.id"


@query(f"{G} {_near_sql('target_id', 'source_id', _NODE)}")
def explore_callers(spark, d):
    g = star.Star(spark, d)
    return traverse.neighbours(g.nodes, g.edges, _NODE, "callers")


@query(f"{G} {_near_sql('source_id', 'target_id', 'order:33')}")
def explore_callees(spark, d):
    g = star.Star(spark, d)
    return traverse.neighbours(g.nodes, g.edges, "order:33", "callees")


@query(f"{G} SELECT id AS source_id, 'customer:7' AS target_id, edge_kind, line FROM ({_near_sql('target_id', 'source_id', 'customer:7')}) UNION ALL SELECT 'customer:7', id, edge_kind, line FROM ({_near_sql('source_id', 'target_id', 'customer:7')})")
def call_paths(spark, d):
    g = star.Star(spark, d)
    return traverse.call_paths(g.nodes, g.edges, "customer:7")


_DOCS = "SELECT 'doc:' || doc_id AS source_id, 'supplier:' || (doc_id % 10) AS target_id, 'documents' AS kind FROM {documents}"


@query(f"SELECT 'doc:' || doc_id AS id, 'doc_' || doc_id AS name, 'doc_section' AS kind, source AS file_path FROM documents WHERE doc_id % 10 = 1")
def related_docs(spark, d):
    return traverse.related_docs(star.nodes(spark, d, ["documents"]), star._run(spark, d, _DOCS), _NODE)


def _levels_sql(seeds: str, depth: int) -> str:
    return f"""seeds AS ({seeds}), walk AS (SELECT seed, id, 0 AS depth FROM seeds UNION SELECT w.seed, e.source_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_id = w.id JOIN nodes n ON n.id = e.source_id
    WHERE w.depth < {depth} AND e.kind IN ('calls', 'imports', 'references')), levels AS (SELECT seed, id, min(depth) AS depth FROM walk GROUP BY seed, id)"""


def _summary_sql(seeds: str, depth: int, graph: str = G) -> str:
    return f"""{graph}, {_levels_sql(seeds, depth)}, sums AS (SELECT l.seed, CAST(count_if(depth = 1) AS BIGINT) AS direct_callers, CAST(count_if(depth > 1) AS BIGINT) AS transitive_callers, count(DISTINCT n.file_path) AS affected_files,
    CAST(count_if(depth > 0 AND n.kind = 'route') AS BIGINT) AS affected_routes FROM levels l LEFT JOIN nodes n ON n.id = l.id GROUP BY l.seed),
    judged AS (SELECT *, CASE WHEN affected_routes > 0 OR direct_callers + transitive_callers > 15 OR affected_files > 5 THEN 'CRITICAL' WHEN direct_callers + transitive_callers > 6 OR affected_files > 2 THEN 'HIGH'
    WHEN direct_callers + transitive_callers > 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM sums)"""


_ONE = "SELECT 'Supplier#000000001' AS seed, 'supplier:1' AS id"
_MANY = "SELECT t.seed, arg_min(n.id, n.ord) AS id FROM (SELECT DISTINCT name AS seed FROM nodes WHERE kind IN ('file', 'class', 'function')) t JOIN nodes n ON lower(n.name) = lower(t.seed) GROUP BY t.seed"


@query(_summary_sql(_ONE, 5) + " SELECT seed, direct_callers, transitive_callers, affected_files, affected_routes, risk, 'Changing ''' || seed || ''' impacts ' || direct_callers || ' direct caller(s), ' || transitive_callers || ' transitive caller(s) across ' || affected_files || ' file(s), and ' || affected_routes || ' HTTP route(s). Risk Level: ' || risk || '.' AS summary FROM judged")
def impact_summary(spark, d):
    g = star.Star(spark, d)
    seeds = resolve.seeds(star.nodes(spark, d), spark.createDataFrame([("Supplier#000000001",)], "seed string"))
    return traverse.impact(g.nodes, g.edges, seeds)


@query(f"{G}, {_levels_sql('SELECT ' + repr('EUROPE') + ' AS seed, id FROM nodes WHERE name = ' + repr('EUROPE'), 5)} SELECT l.seed, l.id, depth, kind, file_path FROM levels l JOIN nodes n ON n.id = l.id")
def impact_levels(spark, d):
    n, g = star.nodes(spark, d), star.Star(spark, d)
    return traverse.impact_levels(g, g, n.where("name = 'EUROPE'").select(F.lit("EUROPE").alias("seed"), "id"))


@query(_summary_sql(_ONE, 5) + " SELECT seed, risk, risk <> 'CRITICAL' AS passed FROM judged")
def audit_gate(spark, d):
    g = star.Star(spark, d)
    return traverse.audit(g.nodes, g.edges, spark.createDataFrame([("Supplier#000000001", "supplier:1")], "seed string, id string"))


@query(_summary_sql(_MANY, 5) + " SELECT seed, risk, risk NOT IN ('CRITICAL', 'HIGH') AS passed FROM judged")
def audit_gate_multi(spark, d):
    n, g = star.nodes(spark, d), star.Star(spark, d)
    return traverse.audit(g, g, resolve.seeds(n, n.where("kind IN ('file', 'class', 'function')").select(F.col("name").alias("seed"))), "MEDIUM")


@query(f"""{G}, walk AS (SELECT 'order:33' AS id, 0 AS depth UNION SELECT e.target_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_id = w.id JOIN nodes n ON n.id = e.target_id WHERE w.depth < 3 AND e.kind IN ('calls', 'references')),
levels AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
tree AS (SELECT l.id, arg_min(p.id, (e.ord, p.id)) AS parent_id FROM levels l JOIN edges e ON e.target_id = l.id AND e.kind IN ('calls', 'references') JOIN levels p ON p.id = e.source_id AND p.depth + 1 = l.depth GROUP BY l.id)
SELECT l.id, l.depth, t.parent_id FROM levels l LEFT JOIN tree t ON t.id = l.id""")
def forward_flow(spark, d):
    g = star.Star(spark, d)
    return traverse.forward_flow(g.nodes, g.edges, "order:33", 3)


@query(f"{G} SELECT count(*) AS callers, CAST(count_if(n.kind = 'route') AS BIGINT) AS routes, CASE WHEN count_if(n.kind = 'route') > 0 OR count(*) > 10 THEN 'CRITICAL' WHEN count(*) > 5 THEN 'HIGH' WHEN count(*) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.target_id = '{_NODE}'")
def blast_radius_1hop(spark, d):
    g = star.Star(spark, d)
    return traverse.blast_radius(g.nodes, g.edges, _NODE)


@query(f"{G} SELECT side, t.id, name, line FROM (SELECT 'caller' AS side, source_id AS id, line FROM edges WHERE kind = 'calls' AND target_id = 'customer:7' UNION ALL SELECT 'callee', target_id, line FROM edges WHERE kind = 'calls' AND source_id = 'customer:7') t JOIN nodes n ON n.id = t.id")
def surgical_context(spark, d):
    g = star.Star(spark, d)
    return traverse.surgical_context(g.nodes, g.edges, "customer:7")


# --- metrics --------------------------------------------------------------------------------------------------------

_kinds = lambda ks: "(VALUES " + ", ".join(f"('{k}')" for k in ks) + ") AS k(kind)"


@query(f"{G} SELECT 'node' AS what, k.kind, count(n.id) AS n FROM {_kinds(schema.NODE_KINDS)} LEFT JOIN nodes n ON n.kind = k.kind GROUP BY k.kind UNION ALL SELECT 'edge', k.kind, count(e.ord) FROM {_kinds(schema.EDGE_KINDS)} LEFT JOIN edges e ON e.kind = k.kind GROUP BY k.kind")
def stats_by_kind(spark, d):
    n = metrics.counts_by_kind(star.nodes(spark, d), schema.NODE_KINDS).select(F.lit("node").alias("what"), "kind", "n")
    return n.unionByName(metrics.counts_by_kind(star.edges(spark, d), schema.EDGE_KINDS).select(F.lit("edge").alias("what"), "kind", "n"))


_DEGREES = "deg AS (SELECT n.id, n.ord, CAST(coalesce(i, 0) AS BIGINT) AS in_degree, CAST(coalesce(o, 0) AS BIGINT) AS out_degree FROM nodes n LEFT JOIN (SELECT target_id, count(*) AS i FROM edges GROUP BY 1) a ON a.target_id = n.id LEFT JOIN (SELECT source_id, count(*) AS o FROM edges GROUP BY 1) b ON b.source_id = n.id)"


@query(f"{G}, {_DEGREES} SELECT id, in_degree, out_degree, in_degree + out_degree AS degree FROM deg")
def degrees(spark, d):
    return metrics.degrees(star.nodes(spark, d), star.edges(spark, d))


@query(f"{G}, {_DEGREES} SELECT id, in_degree + out_degree AS degree, round((in_degree + out_degree) / (SELECT count(*) FROM nodes)::DOUBLE * 100, 2) AS centrality FROM deg ORDER BY degree DESC, ord LIMIT 10")
def degree_centrality(spark, d):
    return metrics.degree_centrality(star.nodes(spark, d), star.edges(spark, d))


def _rank_sql(graph: str = G) -> str:
    out = f"""{graph}, link AS MATERIALIZED (SELECT source_id AS s, target_id AS t, count(*)::DOUBLE AS m FROM edges WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes) GROUP BY 1, 2),
    outs AS MATERIALIZED (SELECT s, sum(m) AS o FROM link GROUP BY s), size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes), r0 AS MATERIALIZED (SELECT id, 1 / n AS r FROM nodes, size)"""
    for k in range(1, 21):
        out += f""", r{k} AS MATERIALIZED (SELECT p.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(f.f, 0) + l.l / n) AS r FROM r{k - 1} p CROSS JOIN size
        CROSS JOIN (SELECT coalesce(sum(r), 0) AS l FROM r{k - 1} WHERE id NOT IN (SELECT s FROM outs)) l
        LEFT JOIN (SELECT t, sum(q.r * m / o) AS f FROM link JOIN outs USING (s) JOIN r{k - 1} q ON q.id = s GROUP BY t) f ON f.t = p.id)"""
    return out


@query(_rank_sql() + " SELECT id, round(r * n, 4) AS scaled_rank FROM r20, size")
def pagerank(spark, d):
    n = star.nodes(spark, d)
    return metrics.pagerank(n, star.edges(spark, d)).select("id", F.round(F.col("page_rank") * F.lit(n.count()), 4).alias("scaled_rank"))


_GODS = f", {_DEGREES} SELECT n.id, n.name, n.file_path, in_degree + out_degree AS degree, in_degree, out_degree, round(r, 4) AS page_rank FROM nodes n JOIN deg ON deg.id = n.id JOIN r20 ON r20.id = n.id WHERE kind NOT IN ('file', 'doc_section') ORDER BY round(r, 4) DESC, degree DESC, n.ord LIMIT 10"


@query(_rank_sql() + _GODS)
def god_nodes(spark, d):
    return metrics.god_nodes(star.nodes(spark, d), star.edges(spark, d))


@query(f"{G} SELECT CAST(count_if(s.id IS NULL OR (t.id IS NULL AND NOT regexp_matches(target_id, '^(sym|pkg|crate|file):'))) AS BIGINT) AS broken_edges, CAST(count_if(t.id IS NULL AND regexp_matches(target_id, '^(sym|pkg|crate|file):')) AS BIGINT) AS external_refs, CAST(count_if(source_id = target_id) AS BIGINT) AS self_loops, count(*) AS total_edges FROM edges e LEFT JOIN nodes s ON s.id = e.source_id LEFT JOIN nodes t ON t.id = e.target_id")
def diagnose_integrity(spark, d):
    return metrics.diagnose(star.nodes(spark, d), star.edges(spark, d))


@query("SELECT p_partkey AS path_key FROM part WHERE p_partkey % 9 = 0")
def missing_files(spark, d):
    p = _table(spark, d, "part").select("p_partkey", F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"))
    named = p.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("file_path"))
    return metrics.missing_files(named, p.where("p_partkey % 9 <> 0")).select(F.substring("path", 3, 20).cast("long").alias("path_key"))


@query(f"{G} SELECT id, name, file_path FROM nodes WHERE kind = 'route'")
def route_registry(spark, d):
    return metrics.route_registry(star.nodes(spark, d))


@query(f"{G} SELECT module, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_nodes FROM (SELECT CASE WHEN contains(file_path, '/') THEN string_split(file_path, '/')[1] ELSE 'root' END AS module, count(*) AS n FROM nodes GROUP BY file_path) GROUP BY module")
def module_map(spark, d):
    return metrics.module_map(star.nodes(spark, d))


@query(f"{G}, top AS (SELECT id FROM nodes ORDER BY ord LIMIT 5000) SELECT source_id, target_id, kind FROM edges WHERE source_id IN (SELECT id FROM top) AND target_id IN (SELECT id FROM top) ORDER BY ord LIMIT 15000")
def visual_subgraph(spark, d):
    return metrics.visual_subgraph(star.nodes(spark, d), star.edges(spark, d))


# --- snapshots and streams ------------------------------------------------------------------------------------------

_OLD = "SELECT 'o/' || o_orderkey AS path, sha2(CAST(o_custkey AS STRING), 256) AS hash, CAST(o_orderkey * 10 AS DOUBLE) AS mtime_ms FROM {orders} WHERE o_orderkey % 7 <> 0"
_NEW = "SELECT 'o/' || o_orderkey AS path, sha2(CAST(CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS STRING), 256) AS hash, CAST(o_orderkey * 10 + CASE WHEN o_orderkey % 10 = 0 THEN 51 ELSE 50 END AS DOUBLE) AS mtime_ms FROM {orders} WHERE o_orderkey % 11 <> 0"
_duck = lambda s: re.sub(r"sha2\((CAST\(.*? AS )STRING\), 256\)", r"sha256(\1VARCHAR))", star.plain(s))
_BOTH = f"WITH a AS ({_duck(_OLD)}), b AS ({_duck(_NEW)})"


def _snapshots(spark, d):
    return star._run(spark, d, _OLD), star._run(spark, d, _NEW)


@query(f"{_BOTH} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'insert' WHEN b.path IS NULL THEN 'delete' ELSE 'update' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash <> b.hash")
def reconcile_diff(spark, d):
    return fresh.reconcile(*_snapshots(spark, d))


@query(f"{_BOTH} SELECT a.path, b.path IS NULL OR (b.mtime_ms > a.mtime_ms + 50 AND a.hash <> b.hash) AS is_stale, CASE WHEN b.path IS NULL THEN 'file_deleted' WHEN b.mtime_ms > a.mtime_ms + 50 AND a.hash <> b.hash THEN 'file_modified_on_disk' END AS reason FROM a LEFT JOIN b ON a.path = b.path")
def freshness(spark, d):
    a, b = _snapshots(spark, d)
    return fresh.freshness(a, b, a).drop("old")


@query(f"{_BOTH} SELECT count_if(a.path IS NULL OR b.path IS NULL OR (abs(a.mtime_ms - b.mtime_ms) > 500 AND a.hash <> b.hash)) > 0 AS heal FROM a FULL JOIN b ON a.path = b.path")
def needs_heal(spark, d):
    return fresh.needs_heal(*_snapshots(spark, d))


@query(f"{_BOTH} SELECT path, hash, mtime_ms FROM b")
def delta_apply(spark, d):
    a, b = _snapshots(spark, d)
    changed = fresh.reconcile(a, b)
    same = a.join(b.select("path", F.col("mtime_ms").alias("now")), "path", "left").withColumn("mtime_ms", F.coalesce("now", "mtime_ms")).drop("now")
    return fresh.upsert(same, b.join(changed.where("change <> 'delete'"), "path", "left_semi"), changed, "path")


_SHARED = "SELECT 'route:' || p_type AS id, 'p/' || p_partkey AS file_path, p_partkey AS version, p_brand AS name FROM {part}"
_LATER = "SELECT 'route:' || CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_type END AS id, 'p/' || p_partkey AS file_path, p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1000000 ELSE 0 END AS version, p_brand AS name FROM {part} WHERE p_partkey % 7 <> 0"


@query(f"SELECT id, arg_max(file_path, file_path) AS file_path, arg_max(version, file_path) AS version, arg_max(name, file_path) AS name, min(file_path) AS first_path FROM ({star.plain(_LATER)}) GROUP BY id")
def delta_shared_ids(spark, d):
    """Ids that many files share: edits, and deletions of the file whose row counts and of others, applied to all files' versions."""
    old, new = star._run(spark, d, _SHARED), star._run(spark, d, _LATER)
    marks = [df.select(F.col("file_path").alias("path"), F.xxhash64("id", "version").alias("hash")) for df in (old, new)]
    changed = fresh.reconcile(*marks)
    fresh_rows = new.join(changed.where("change <> 'delete'").select(F.col("path").alias("file_path")), "file_path", "left_semi").select(*old.columns)
    rows = fresh.upsert(old, fresh_rows, changed).withColumn("file_ord", F.col("file_path")).withColumn("emit_ord", F.lit(0))
    return last_writer(rows).select("id", "file_path", "version", "name", F.col("file_ord").alias("first_path"))


@query("WITH g AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM g) SELECT user_id AS key, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, count(*) AS n, count(DISTINCT event_type) AS n_items FROM s GROUP BY user_id, b")
def debounce_batches(spark, d):
    rows = fresh.debounce(_table(spark, d, "events"), "user_id", "ts", "event_type", "10 minutes")
    return rows.withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_ROOTS = "SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS root FROM {pages}"


@query("WITH roots AS (SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS root FROM pages), paths AS (SELECT DISTINCT url AS path FROM pages) SELECT path, arg_max(root, length(root)) AS root FROM paths LEFT JOIN roots ON path = root OR starts_with(path, root || '/') GROUP BY path")
def ancestor_workspace(spark, d):
    return fresh.ancestor(star._run(spark, d, _ROOTS), _table(spark, d, "pages").select(F.col("url").alias("path")))
