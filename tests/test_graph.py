import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.functions.frames import last_writer
from quillgraph.operators import fresh, metrics, resolve, traverse
from quillgraph.parse import parse
from quillgraph.sources import workspace

NODE = "id string, name string, kind string, file_path string, ord long"
EDGE = "source_id string, target_id string, target_name string, kind string, file_path string, line int, ord long"


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, i, k, f, o) for o, (i, k, f) in enumerate(nodes)], NODE)
    e = spark.createDataFrame([(s, t, None, k, "f", 1, o) for o, (s, t, k) in enumerate(edges)], EDGE)
    return n, e


TOKENS = {
    "loadUserProfile": "loaduserprofile load user profile", "HTTPServerV2": "httpserverv2 http server v2", "order_line-item": "order line item orderlineitem", "XMLtoJSON": "xmltojson xm lto json",
    "src/util/io.ts": "src util io ts srcutiliots", "Customer#000000001": "customer 000000001 customer000000001", "a": "",
}


def test_tokens(spark):
    df = spark.createDataFrame([(k,) for k in TOKENS], "n string")
    assert {r.n: " ".join(r.t) for r in df.select("n", text.symbol_tokens(F.col("n")).alias("t")).collect()} == TOKENS


PR = dict(A=0.182485, B=0.176929, C=0.384579, D=0.182485, E=0.073521)
PR_EDGES = [("A", "B"), ("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("C", "D"), ("C", "C"), ("A", "sym:zz")]


@pytest.mark.parametrize("one_task", [metrics.ONE_TASK, 0])
def test_pagerank(spark, one_task):
    n, e = graph(spark, [(c, "function", "f") for c in "ABCDE"], [(a, b, "calls") for a, b in PR_EDGES])
    got = {r.id: r.page_rank for r in metrics.pagerank(n, e, one_task).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == PR and abs(sum(got.values()) - 1) < 1e-9


CASES = [
    ([("b", "a"), ("c", "b"), ("d", "c"), ("a", "a"), ("r", "b")], 1, (1, 0, "LOW")),
    ([("b", "a"), ("c", "b"), ("d", "c"), ("a", "a"), ("r", "b")], 2, (1, 2, "CRITICAL")),
    ([("b", "a"), ("c", "b"), ("d", "c")], 3, (1, 2, "MEDIUM")),
    ([(f"x{i}", "a") for i in range(7)], 3, (7, 0, "HIGH")),
    ([(f"x{i}", "a") for i in range(16)], 3, (16, 0, "CRITICAL")),
]


@pytest.mark.parametrize("edges,depth,want", CASES)
def test_impact(spark, edges, depth, want):
    ids = sorted({x for e in edges for x in e})
    n, e = graph(spark, [(i, "route" if i == "r" else "function", "f") for i in ids], [(a, b, "calls") for a, b in edges])
    row = traverse.impact_of(n, e, "A", depth).first()
    assert (row.direct_callers, row.transitive_callers, row.risk) == want


def test_reach_on_random_graphs(spark):
    r = random.Random(3)
    nodes = [f"n{i}" for i in range(25)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(50)]
    level, seen = {"n0"}, {"n0": 0}
    for d in range(1, 5):
        level = {s for s, t in edges if t in level} - set(seen)
        seen |= dict.fromkeys(level, d)
    steps = spark.createDataFrame([(t, s) for s, t in edges], "at string, to string")
    got = traverse.reach(spark.createDataFrame([("n0", "n0")], "seed string, id string"), steps, 4)
    assert {x.id: x.depth for x in got.collect()} == seen


def test_resolution(spark):
    n = spark.createDataFrame([("a.ts#Get", "Get", "function", "a.ts", 0), ("b.ts#Get", "Get", "function", "b.ts", 1), ("x#One", "One", "class", "x", 2)], NODE)
    e = spark.createDataFrame([("s", t, None, "calls", f, 1, i) for i, (t, f) in enumerate([("sym:get", "b.ts"), ("sym:Get", "c.ts"), ("sym:ONE", "q"), ("sym:Nope", "q"), ("pkg:x", "q"), ("gone#Get", "b.ts"), ("x#One", "q")])], EDGE)
    got = [(r.target_id, r.confidence) for r in resolve.resolve(n, e).orderBy("ord").collect()]
    assert got == [("b.ts#Get", "exact"), ("a.ts#Get", "heuristic"), ("x#One", "exact"), ("sym:Nope", None), ("pkg:x", None), ("b.ts#Get", "exact"), ("x#One", None)]


def test_last_writer(spark):
    df = spark.createDataFrame([("a", 1, "p", 0), ("b", 2, "p", 1), ("a", 3, "q", 0)], "id string, v int, file_ord string, emit_ord int")
    assert sorted(map(tuple, last_writer(df).collect())) == [("a", 3, "p", 0), ("b", 2, "p", 1)]


def test_freshness(spark):
    index = spark.createDataFrame([(p, "h" * 12, 1000.0) for p in "abcd"], "path string, hash string, mtime_ms double")
    disk = spark.createDataFrame([("a", "n", 1050.0), ("b", "n", 1051.0), ("c", "h" * 12, 1051.0)], "path string, hash string, mtime_ms double")
    asked = spark.createDataFrame([(p,) for p in "abcdz"], "path string")
    rows = fresh.freshness(index, disk, asked)
    assert {r.path: r.reason for r in rows.collect()} == {"a": None, "b": "file_modified_on_disk", "c": None, "d": "file_deleted", "z": None}
    assert fresh.freshness_summary(rows).first() == (True, "file_deleted", "h" * 32)
    assert fresh.freshness_summary(rows.limit(0)).first() == (False, None, "clean")


def test_debounce_and_ancestor(spark):
    ev = spark.createDataFrame([("w", s, str(s)) for s in (0, 10, 19, 40)], "k string, s int, p string").withColumn("t", F.timestamp_seconds("s"))
    assert sorted(r.n for r in fresh.debounce(ev, "k", "t", "p").collect()) == [1, 3]
    roots, paths = spark.createDataFrame([("/w",), ("/w/x",)], "root string"), spark.createDataFrame([("/w/x/src/f",), ("/w/xy",), ("/q",)], "path string")
    assert {r.path: r.root for r in fresh.ancestor(roots, paths).collect()} == {"/w/x/src/f": "/w/x", "/w/xy": "/w", "/q": None}


def edges_of(g):
    return {(e[4], e[1].split("#")[-1], e[2], e[6]) for e in g.edges.values() if e[4] != "contains"}


def nodes_of(g):
    return [(n[1], n[2], n[4], n[5]) for n in g.nodes.values()][1:]


def test_parse_script():
    g = parse("shop/cart.ts", "import { tax } from '../lib/tax';\nexport class Cart extends Base {\n  total(x) { return round(tax(x)); }\n}\nfunction round(n) { return n; }\napi.post('/cart', total);\n")
    assert {("Cart", "class", 2, 4), ("total", "function", 3, 3), ("round", "function", 5, 5), ("POST /cart", "route", 6, 6)} == set(nodes_of(g))
    assert edges_of(g) == {("imports", "file:shop/cart.ts", "file:lib/tax", 1), ("extends", "Cart", "sym:Base", 2), ("calls", "total", "sym:round", 3), ("calls", "total", "sym:tax", 3), ("references", "route:POST:/cart", "shop/cart.ts#total", 6)}
    tricky = parse("t.js", "const a = /[/(]x(/.test(s) ? `x ${run(`y`)} fake(` : 'no(1)'; // not(2)\nconst f = async (q) => { go(q); };\n")
    assert ("calls", "f", "sym:go", 2) in edges_of(tricky) and not any("fake" in e[2] or "not" in e[2] for e in edges_of(tricky))


def test_parse_others():
    g = parse("svc/a.py", "class A(B):\n    def run(self):\n        return step(1)\n\ndef step(n):\n    return n")
    assert nodes_of(g) == [("A", "class", 1, 3), ("run", "function", 2, 3), ("step", "function", 5, 6)]
    assert edges_of(g) == {("extends", "A", "sym:B", 1), ("calls", "run", "sym:step", 3)}
    g = parse("d.sql", "CREATE TABLE parent (id INT);\nCREATE TABLE child (\n id INT,\n pid INT,\n FOREIGN KEY (pid) REFERENCES parent(id)\n);")
    assert [n[0] for n in nodes_of(g)] == ["parent", "child"] and edges_of(g) == {("references", "child", "sym:parent", 5)}
    g = parse("r.md", "# A\r\ntext `foo()` and `ab`\n## B\n`foo`")
    assert [(n[0], n[2], n[3]) for n in nodes_of(g)] == [("A", 1, 4), ("B", 3, 4)] and {e[2] for e in edges_of(g)} == {"sym:foo"}
    g = parse("A.java", '@RequestMapping("/api")\npublic abstract class A extends B implements D {\n  @GetMapping("/x")\n  public int run(int a) { return step(a); }\n}')
    assert ("GET /api/x", "route", 3, 3) in nodes_of(g) and {("extends", "A", "sym:B", 2), ("calls", "run", "sym:step", 4)} <= edges_of(g)
    for path, code, name in (("m.go", "package m\nfunc (s *S) Run() {\n help(1)\n}", "S.Run"), ("l.rs", "fn make(x: X) -> P {\n help(x)\n}", "make"), ("k.cs", "class K {\n public int Go(int a) {\n  return help(a);\n }\n}", "Go"), ("r.rb", "def go(a)\n  help(a)\nend", "go"), ("u.php", "<?php\nfunction go($a) {\n return help($a);\n}", "go"), ("w.dart", "int go(int a) {\n return help(a);\n}", "go"), ("q.kt", "fun go(a: Int): Int {\n return help(a)\n}", "go")):
        g = parse(path, code)
        assert name in [n[0] for n in nodes_of(g)] and any(e[0] == "calls" and e[2] == "sym:help" for e in edges_of(g)), path


def test_scan_rules():
    assert workspace.wanted("p/__init__.py", 1) and workspace.wanted(".hidden.ts", 1) and workspace.wanted("x.swift", 1)
    assert not any(workspace.wanted(p, s) for p, s in (("node_modules/a.js", 1), ("a.ts", (1 << 20) + 1), ("y.txt", 1), ("a.min.js", 1)))


def test_plain_words_have_the_tokens_of_the_long_way(spark):
    import re

    def long_way(name):
        segments = [x for x in re.split("[^a-zA-Z0-9]+", name.strip(" ")) if x]
        out = []
        for x in segments:
            parts = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", x)).split(" ")
            out += [x.lower(), *[w.lower() for w in parts]]
        out.append(re.sub("[^a-zA-Z0-9]", "", name).lower())
        return list(dict.fromkeys(w for w in out if 2 <= len(w) <= 50))

    r = random.Random(4)
    words = ["", "a", "A", "ab\n", "Ab", "x" * 50, "x" * 51, "\u00e9ab", *["".join(r.choice("abAB1_ -\n") for _ in range(r.randint(1, 6))) for _ in range(500)]]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.symbol_tokens(F.col("w")).alias("t")).collect()
    assert all(row.t == long_way(row.w) for row in rows)


def test_source_lines(spark):
    row = spark.sql("SELECT 'a\\nb\\nc\\nd\\ne' AS x").select(*[text.source_lines(F.col("x"), F.lit(a), F.lit(b), k).alias(n) for n, a, b, k in (("mid", 3, 3, 1), ("all", 1, 5, 2), ("end", 5, 5, 2), ("out", 9, 9, 2))]).first()
    assert (row.mid, row.all, row.end, row.out) == ("b\nc\nd", "a\nb\nc\nd\ne", "c\nd\ne", "")
