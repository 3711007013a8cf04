"""Shared pieces of the parsers: rows, lines, masks, blocks, calls."""

from __future__ import annotations

import itertools
import json
import operator
import re
from bisect import bisect_left
from dataclasses import dataclass, field

from quillgraph.functions.text import CALL_STOP

#: Words before "(" that are no calls: the fixed ones, and keywords of the languages that are never names.
NOT_CALLS = {*CALL_STOP, *"elif else except and or not in is await yield do try until unless when foreach using lock synchronized".split()}
BRACE, PARENS = re.compile(r"[{}]"), re.compile(r"[()]")


@dataclass
class Graph:
    """Rows of one file. The first node of an id wins here; edges keep parallel lines."""

    path: str
    text: str
    nodes: dict = field(default_factory=dict)
    edges: dict = field(default_factory=dict)

    def __post_init__(self):
        self.lines = self.text.split("\n")
        self.breaks = list(map(operator.add, itertools.accumulate(map(len, self.lines[:-1])), itertools.count()))

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def node(self, kind: str, name: str, start: int, end: int, id_: str | None = None, snippet: int = 7, signature: str | None = None, **metadata) -> str:
        id_ = id_ or f"{self.path}#{name}"
        if id_ not in self.nodes:
            code = "\n".join(self.lines[start - 1 : min(end, start - 1 + snippet)])
            self.nodes[id_] = (id_, name, kind, self.path, start, end, code, signature or self.lines[start - 1].strip()[:200], None, json.dumps(metadata) if metadata else None)
            if kind != "file":
                self.edge("contains", f"file:{self.path}", id_, name, start)
        return id_

    def edge(self, kind: str, source: str, target: str, name: str | None, line: int, confidence: str = "exact", infix: str = "", **metadata) -> None:
        id_ = f"edge:{kind}:{source}->{infix}{target}:{line}"
        self.edges.setdefault(id_, (id_, source, target, name, kind, self.path, line, confidence, json.dumps(metadata) if metadata else None))

    def calls(self, caller: str, name: str, code: str, offset: int) -> None:
        """Edges of the names called in ``code`` (masked), once per name and line, none to the caller on its own first line."""
        for m in re.finditer(r"(?<![\w$])(?:new\s+)?((?:[\w$]+\s*(?:\?\.|\.|::|->)\s*)*)([A-Za-z_$][\w$]*)\s*(?:!\s*)?\(", code):
            callee = m.group(2)
            line = self.line(offset + m.start(2))
            if callee in NOT_CALLS or (callee == name and line == self.line(offset)):
                continue
            self.edge("calls", caller, f"sym:{callee}", callee, line)


def mask(text: str, line_comments: tuple[str, ...] = ("//",), block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`", regex: bool = False, triple: bool = False) -> str:
    """``text`` with the insides of strings and comments blanked; positions and line breaks stay. Code in ${} stays."""
    out, i, n, stack = list(text), 0, len(text), []

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if stack and c in "{}":
            if c == "{":
                stack[-1] += 1
            else:
                stack[-1] -= 1
                if not stack[-1]:  # the end of ${}: back in its template
                    stack.pop()
                    i = _template(text, i + 1, blank, stack)
                    continue
        if block and text.startswith(block[0], i):
            end = text.find(block[1], i + len(block[0]))
            end = n if end < 0 else end + len(block[1])
            blank(i, end)
            i = end
        elif any(text.startswith(p, i) for p in line_comments):
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif triple and text[i : i + 3] in ('"""', "'''"):
            end = text.find(text[i : i + 3], i + 3)
            end = n if end < 0 else end + 3
            blank(i, end)
            i = end
        elif c == "`" and "`" in quotes:
            i = _template(text, i + 1, blank, stack)
        elif c in quotes:
            end = i + 1
            while end < n and text[end] != c and text[end] != "\n":
                end += 2 if text[end] == "\\" else 1
            blank(i + 1, end)
            i = min(end, n) + 1
        elif regex and c == "/" and re.search(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of))\s*$", text[max(0, i - 20) : i]):
            end, inside = i + 1, False
            while end < n and text[end] != "\n" and (inside or text[end] != "/"):
                inside = text[end] == "[" or (inside and text[end] != "]")
                end += 2 if text[end] == "\\" else 1
            blank(i, end + 1)
            i = end + 1
        else:
            i += 1
    return "".join(out)


def _template(text: str, i: int, blank, stack: list[int]) -> int:
    """Blank a template literal from ``i`` up to its end or its next ${."""
    start, n = i, len(text)
    while i < n:
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            blank(start, i)
            return i + 1
        elif text.startswith("${", i):
            blank(start, i + 2)
            stack.append(1)
            return i + 2
        else:
            i += 1
    blank(start, n)
    return n


def braces(code: str, at: int) -> tuple[int, int] | None:
    """(open, close) of the first balanced pair at or after ``at``, unless a statement ends before it."""
    start = code.find("{", at)
    stop = code.find(";", at)
    if start < 0 or (0 <= stop < start and code.count("(", at, stop) <= code.count(")", at, stop)):
        return None
    depth = 0
    for m in BRACE.finditer(code, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return start, m.start()
    return start, len(code) - 1


def closing(code: str, at: int) -> int:
    """Position of the bracket that closes the one at ``at``; the end of the code without one."""
    depth = 0
    for m in PARENS.finditer(code, at):
        depth += 1 if m.group() == "(" else -1
        if not depth:
            return m.start()
    return len(code)


def names(listing: str) -> list[str]:
    """Base names of a comma-separated heritage list, generics and arguments dropped."""
    flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", re.sub(r"\([^()]*\)", "", listing)))
    return [w for part in flat.split(",") if (w := re.split(r"[\s({]", part.strip())[0]) and re.match(r"[\\A-Za-z_$]", w)]


def top_level(listing: str) -> list[str]:
    """Parts of a listing between its commas outside brackets."""
    parts, depth = [""], 0
    for c in listing:
        depth += 1 if c in "([{" else -1 if c in ")]}" else 0
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def resolve_path(path: str, target: str) -> str:
    """A relative import as a path from the root."""
    parts = path.split("/")[:-1]
    for p in target.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)
