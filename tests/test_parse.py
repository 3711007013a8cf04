"""The script and Python parsers against programs whose answers are known, and against Python's own parser."""

import ast
import glob
import os
import random

from quillgraph.parse import languages, parse
from quillgraph.parse.base import NOT_CALLS, Graph
from quillgraph.plans.code import PIECES

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(g):
    nodes = {(n[2], n[1], n[4], n[5]) for n in g.nodes.values() if n[2] != "file"}
    return nodes, {(e[4], e[1].split("#")[-1], e[3], e[6]) for e in g.edges.values() if e[4] != "contains"}


def program(rng, ext, depth=0):
    """(lines, nodes, edges (kind, caller or None, target, line)) of random pieces, nested in functions, methods and blocks."""
    lines, nodes, edges = [], [], []
    for _ in range(rng.randint(1, 4)):
        k = f"_{rng.randrange(10**9)}"
        if depth < 3 and rng.random() < 0.4:
            inner, n, e = program(rng, ext, depth + 1)
            if ext == "ts":
                name, head, tail = rng.choice([
                    (f"f{k}", f"async function f{k}(a: {{ b: string }} = {{ b: ':{{' }}): Promise<void> {{", "}"), (f"v{k}", f"const v{k} = ({{ a }}: A, ...r: B[]): void => {{", "};"), (f"m{k}", f"const o{k} = {{ m{k}<T>(q: T) {{", "} };"),
                    (None, f"namespace S{k} {{", "}"), (None, "if (a < b && c > d) {", "} else { /* no( */ }"),
                ])
                inner = [head, *inner, tail]
                nodes += [("function", name, len(lines) + 1, len(lines) + len(inner))] if name else []
            else:
                name, head = rng.choice([(f"f{k}", f"def f{k}(a: dict[str, int] = {{':': 1}}, b=lambda q: q) -> 'no(1):':"), (f"g{k}", f"async def g{k}():"), (None, f"class K{k}:"), (None, "if a[1:2] == {1: 2}:")])
                nodes += [("function", name, len(lines) + 1, len(lines) + 1 + len(inner))] if name else [("class", f"K{k}", len(lines) + 1, len(lines) + 1 + len(inner))] if head.startswith("class") else []
                inner = [head, *["    " + x for x in inner]]
            shift = len(lines) + 1
            nodes += [(a, b, c + shift, d + shift) for a, b, c, d in n]
            edges += [(a, b, c, d + shift) for a, b, c, d in e]
            edges += [("calls", name, c, d) for c, d in {(c, d + shift) for a, _, c, d in e if a == "calls"}] if name else []
        else:
            content, n, e = rng.choice(PIECES[ext][:9] if ext == "py" else [p for p in PIECES[ext] if "router" not in p[0]])
            shift, inner = len(lines), content.replace("{k}", k).split("\n")
            nodes += [(a, b.replace("{k}", k), c + shift, d + shift) for a, b, c, d in n]
            g = parse(f"x.{ext}", "\n".join(inner))  # callers of a piece alone; its edges are stated in PIECES and checked by parse_programs
            edges += [(a, b, c, d + shift) for a, b, c, d in rows(g)[1]]
            if depth:  # what a piece calls outside its own functions belongs to those around it
                whole = parse(f"x.{ext}", ("function w() {\n" if ext == "ts" else "def w():\n") + "\n".join(inner if ext == "ts" else ["  " + x for x in inner]) + ("\n}" if ext == "ts" else ""))
                edges += [("calls", None, c, d - 1 + shift) for a, b, c, d in rows(whole)[1] if a == "calls" and b == "w"]
        lines += inner
    return lines, nodes, edges


def test_nested_programs():
    """600 programs of nested functions, methods, namespaces, classes and conditions: every function has all calls within."""
    rng = random.Random(11)
    for turn in range(600):
        ext = ("ts", "py")[turn % 2]
        lines, nodes, edges = program(rng, ext)
        got_nodes, got_edges = rows(parse(f"x.{ext}", "\n".join(lines)))
        assert got_nodes == set(nodes), "\n".join(lines)
        assert got_edges == {e for e in edges if e[1]}, "\n".join(lines)


def test_python_agrees_with_ast():
    """(function, callee) pairs of this repository's own files."""
    both = here = there = 0
    for path in glob.glob(f"{HERE}/quillgraph/**/*.py", recursive=True) + glob.glob(f"{HERE}/tests/**/*.py", recursive=True):
        with open(path) as f:
            text = f.read()
        want = set()
        for d in ast.walk(ast.parse(text)):
            if isinstance(d, ast.FunctionDef | ast.AsyncFunctionDef):
                for call in (c for part in [*d.body, d.args, *filter(None, [d.returns])] for c in ast.walk(part) if isinstance(c, ast.Call)):
                    name = getattr(call.func, "id", getattr(call.func, "attr", None))
                    want |= {(d.name, name)} if name and name not in NOT_CALLS else set()
        g = Graph(path, text)
        languages.python(g)
        got = {(caller, name) for kind, caller, name, _ in rows(g)[1] if kind == "calls"}
        both, here, there = both + len(want & got), here + len(got), there + len(want)
    assert there > 3000 and both >= 0.99 * there and both >= 0.99 * here


def test_header_ends_at_its_own_colon():
    _, edges = rows(parse("a.py", "def f(a):\n    x = load(a)\n    y = save(x)\n    if y:\n        done(y)\ndef g(x): return {1: save(x)}\ndef h(x):\n    return [lambda: pick(x)][0]\n"))
    assert edges == {("calls", "f", "load", 2), ("calls", "f", "save", 3), ("calls", "f", "done", 5), ("calls", "g", "save", 6), ("calls", "h", "pick", 8)}


def test_elements_and_odd_scripts():
    code = """import React, { useState as us } from 'react';
export function View({ items, on = dflt() }: Props) {
  const [s, set] = us(0);
  return <div className="it's" onClick={() => on(s)}>Don't {items.map(i => <Row key={i} {...spread(i)}>{fmt(i)} isn't</Row>)} <br/> <></> </div>;
}
const G = <T extends object>(x: T) => <p>{x ? yes() : no()}</p>;
"""
    nodes, edges = rows(parse("a.tsx", code))
    assert nodes == {("function", "View", 2, 5), ("function", "G", 6, 6)}
    assert edges == {("imports", "file:a.tsx", "react", 1), *[("calls", "View", c, 3 if c == "us" else 4) for c in ("us", "on", "spread", "fmt")], ("calls", "G", "yes", 6), ("calls", "G", "no", 6)}
    for broken in ("class {", "function (", "const a = `${", "((((", "}}})", "a ? b", "import {", "export default", "x = <div", "new", "@", "enum", "interface X extends", "({ get", "for (;", "class A { [", "`", "'", "/", "type A = "):
        assert len(parse("a.tsx", broken).nodes) >= 1 and len(parse("a.ts", f"function ok() {{ go(); }}\n{broken}").edges) >= 2
    assert ("calls", "deep", "go", 1) in rows(parse("a.js", "function deep() { return " + "(" * 700 + "go()" + ")" * 700 + "; }"))[1]
