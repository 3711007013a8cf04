"""Parsers of the other languages: declarations by pattern over masked source, blocks by braces or indentation."""

from __future__ import annotations

import bisect
import keyword
import re

from quillgraph.parse.base import NOT_CALLS, Graph, braces, closing, mask, names, resolve_path, top_level


def _block(g: Graph, code: str, start: int, after: int) -> tuple[int, int, int]:
    """(end line, body start, body end) of a declaration; its own line where it has no body."""
    span = braces(code, after)
    return (g.line(span[1]), span[0], span[1] + 1) if span else (g.line(start), after, after)


_PYTHON_STRING = re.compile(r"(?<![\w])([rRbBuUfFtT]{0,3})(\"{3}|'{3}|\"|')|#[^\n]*")
#: What ends or goes on with a string's inside, by its quote.
_PYTHON_INSIDE = {q: re.compile(rf"[^\\{q}\n]*(?:\\.[^\\{q}\n]*)*", re.S) for q in "'\""} | {q * 3: re.compile(rf"[^\\{q}]*(?:(?:\\.|{q}(?!{q}{q}))[^\\{q}]*)*", re.S) for q in "'\""}
_PYTHON_WORD, _PYTHON_CODE = re.compile(r"\w+"), re.compile(r"[^\n]+")
_PYTHON_QUOTE, _PYTHON_PREFIX = re.compile(r"['\"#]"), re.compile(r"(?<![\w])[rRbBuUfFtT]{1,3}\Z")
_PYTHON_NAME = re.compile(r"\([ \t]*(\w+)")  # of the code backwards, where each begins with what is sought first
_PYTHON_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n]+)|import[ \t]+([^\n]+))", re.M)
_PYTHON_BRACKETS, _PYTHON_COLONS = re.compile(r"[()\[\]{}]"), re.compile(r"[()\[\]{}:]")
_PYTHON_DECLARED = re.compile(r"\b(?:def|class)[ \t]+$")
_PYTHON_BLOCK = re.compile(r"^([ \t]*)(?:(class)|(?:async[ \t]+)?def)[ \t]+(\w+)", re.M)
_PYTHON_ROUTE = re.compile(r"^[ \t]*@\w+\.(get|post|put|delete|patch|options|route)\([ \t]*(['\"])", re.M)
_NOT_PYTHON_CALLS = NOT_CALLS | set(keyword.kwlist)


def mask_python(text: str) -> str:
    """``text`` with the insides of strings and comments blanked; positions, line breaks and the code in f-strings stay."""
    out, n, done = [], len(text), 0

    def blank(a: int, b: int) -> None:
        nonlocal done
        if b > a:
            inside = text[a:b]
            out.append(text[done:a])
            out.append(_PYTHON_CODE.sub(lambda m: " " * len(m.group()), inside) if "\n" in inside else " " * len(inside))
            done = min(b, n)

    def code(i: int, end: int) -> int:
        """Mask the code of an f-string's field from ``i`` to what ends it. The place where it stops."""
        depth = 0
        while i < end:
            c = text[i]
            if not depth and (c in "}:" or (c == "!" and text[i + 1 : i + 2] != "=")):
                return i
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
            m = _PYTHON_STRING.match(text, i) if c in "'\"rRbBuUfFtT" else None
            if m and m.group(2):
                i = string(m.end(), m.group(1), m.group(2))
            elif c.isalnum() or c == "_":
                i = _PYTHON_WORD.match(text, i).end()
            else:
                i += 1
        return end

    def string(start: int, prefix: str, quote: str) -> int:
        if not prefix or not ("f" in (prefix := prefix.lower()) or "t" in prefix):
            i = _PYTHON_INSIDE[quote].match(text, start).end()
            if i < n and text[i] == "\\":  # the last character of the text
                i += 2
            blank(start, i)
            return min(i + len(quote), n)
        i = start
        while i < n and not text.startswith(quote, i):
            if text[i] == "\\":
                i += 2
            elif text[i] == "\n" and len(quote) == 1:
                break
            elif text[i] == "{":
                if text.startswith("{{", i):
                    i += 2
                    continue
                blank(start, i + 1)
                start = i = field(i + 1)
            else:
                i += 1
        blank(start, i)
        return min(i + len(quote), n)

    def field(i: int) -> int:
        """An f-string's replacement field from behind its brace; the format after a colon may hold further fields."""
        i = code(i, n)
        at = i
        while i < n and text[i] not in "}\n":
            if text[i] == "{":
                blank(at, i + 1)
                at = i = field(i + 1)
            else:
                i += 1
        blank(at, i + 1)
        return i + 1

    i = 0
    while m := _PYTHON_QUOTE.search(text, i):
        at, quote = m.start(), m.group()
        if quote == "#":
            i = text.find("\n", at)
            i = n if i < 0 else i
            blank(at + 1, i)
            continue
        prefix = ""
        if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            prefix = m.group() if (m := _PYTHON_PREFIX.search(text, max(i, at - 3), at)) else None
        quote = quote * 3 if text.startswith(quote * 3, at) else quote
        i = at + 1 if prefix is None else string(at + len(quote), prefix, quote)
    return "".join(out) + text[done:]


def python(g: Graph) -> None:
    code = mask_python(g.text)
    file_id = f"file:{g.path}"
    for m in _PYTHON_IMPORT.finditer(code) if "import" in code else ():
        at = g.line(m.start())
        if m.group(1):
            module, listing = m.group(1), re.sub(r"[()\n]", " ", m.group(2))
            symbols = [re.split(r"\s+as\s+", p.strip())[0] for p in listing.split(",") if p.strip()]
            _python_import(g, file_id, module, symbols, at)
        else:
            for p in m.group(3).split(","):
                _python_import(g, file_id, re.split(r"\s+as\s+", p.strip())[0], [], at)
    # lines that begin a logical line: (number, indent, start); those inside brackets or after a backslash only continue one
    logical, depth, at, joined = [], 0, 0, False
    for number, row in enumerate(code.split("\n"), 1):
        if not depth and not joined and (bare := row.lstrip()) and bare[0] == g.lines[number - 1].lstrip()[0]:
            logical.append((number, len(row) - len(bare), at))
        for c in _PYTHON_BRACKETS.findall(row):
            if c in "([{":
                depth += 1
            elif depth:
                depth -= 1
        joined = row.endswith("\\")
        at += len(row) + 1
    filled = [k for k, row in enumerate(g.lines, 1) if row and not row.isspace()]

    def stop(after: int, indent: int) -> int:
        """The last line of a block whose header ends on line ``after``."""
        k = bisect.bisect_right(logical, (after, len(code), len(code)))
        while k < len(logical) and logical[k][1] > indent:
            k += 1
        below = logical[k][0] if k < len(logical) else len(g.lines) + 1
        return max(after, filled[bisect.bisect_left(filled, below) - 1] if filled else after)

    spots = []
    for m in _PYTHON_NAME.finditer(code[::-1]):
        name, at = m.group(1)[::-1], len(code) - m.end()
        if name not in _NOT_PYTHON_CALLS and not name[0].isdecimal() and not (at and code[at - 1] in " \t\n" and _PYTHON_DECLARED.search(code[max(0, at - 12) : at])):
            spots.append((at, name))
    spots.reverse()
    starts = [at for at, _ in spots]
    for m in _PYTHON_BLOCK.finditer(code):
        depth, colon = 0, len(code)
        for c in _PYTHON_COLONS.finditer(code, m.end()):  # to the header's own colon
            if c.group() != ":":
                depth += 1 if c.group() in "([{" else -1
            elif not depth:
                colon = c.start()
                break
        begin, indent = g.line(m.start(3)), len(m.group(1))
        end = stop(g.line(min(colon, len(code) - 1)), indent)
        if m.group(2):
            id_ = g.node("class", m.group(3), begin, end, snippet=5)
            head = code[m.end() : colon]
            inner = head[head.find("(") + 1 : head.rfind(")")] if "(" in head else ""
            for base in top_level(inner):
                name = re.match(r"[A-Za-z_][\w.]*", base)
                if name and name.group() != "object" and not re.match(r"\w+\s*=[^=]", base):
                    g.edge("extends", id_, f"sym:{name.group()}", name.group(), begin)
        else:
            id_ = g.node("function", m.group(3), begin, end)
            finish = g.breaks[end - 1] if end - 1 < len(g.breaks) else len(code)
            for at, name in spots[bisect.bisect_left(starts, m.end()) : bisect.bisect_left(starts, finish)]:
                g.edge("calls", id_, f"sym:{name}", name, g.line(at))
    for m in _PYTHON_ROUTE.finditer(code) if "@" in code else ():
        where = g.text[m.end() : g.text.find(m.group(2), m.end())]
        verb = {"route": "ROUTE"}.get(m.group(1), m.group(1).upper())
        g.node("route", f"{verb} {where}", g.line(m.start()), g.line(m.start()), f"route:{verb}:{where}", 1, method=verb, routePath=where)


def _python_import(g: Graph, file_id: str, module: str, symbols: list[str], at: int) -> None:
    if not module:
        return
    dots = len(module) - len(module.lstrip("."))
    if dots:
        path = resolve_path(g.path, "/".join([*[".."] * (dots - 1), *module.lstrip(".").split(".")]))
    else:
        path = module.replace(".", "/")
    g.edge("imports", file_id, f"file:{path}", module, at, importedSymbols=symbols)


def go(g: Graph) -> None:
    code = mask(g.text)
    file_id = f"file:{g.path}"
    if m := re.search(r"^package\s+(\w+)", code, re.M):
        g.edge("contains", file_id, f"pkg:{m.group(1)}", m.group(1), g.line(m.start()))
    for m in re.finditer(r"^import\s*(?:\((.*?)\)|[^\n(]*)", code, re.M | re.S):
        for q in re.finditer(r"(?:^|\n)?[ \t]*(?:([\w.]+)[ \t]+)?([\"`])([^\"`\n]+)\2", g.text[m.start() : m.end()].replace("import", "      ", 1)):
            g.edge("imports", file_id, f"pkg:{q.group(3)}", q.group(3), g.line(m.start() + q.start(3)), alias=q.group(1))
    for m in re.finditer(r"^[ \t]*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\s*\{", code, re.M):
        end, _, _ = _block(g, code, m.start(), m.end() - 1)
        g.node("class" if m.group(2) == "struct" else "interface", m.group(1), g.line(m.start(1)), end, snippet=5)
    for m in re.finditer(r"^func\s+(?:\(\s*(?:\w+\s+)?\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)", code, re.M):
        name = f"{m.group(1)}.{m.group(2)}" if m.group(1) else m.group(2)
        end, a, b = _block(g, code, m.start(), m.end())
        id_ = g.node("method" if m.group(1) else "function", name, g.line(m.start()), end)
        if m.group(1):
            g.edge("contains", f"{g.path}#{m.group(1)}", id_, name, g.line(m.start()))
        g.calls(id_, m.group(2), code[a:b], a)


def rust(g: Graph) -> None:
    code = mask(g.text, quotes='"')
    file_id = f"file:{g.path}"
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", code, re.M):
        path = re.sub(r"\s+", "", re.split(r"\{|\s+as\s+", m.group(1))[0]).rstrip(":")
        g.edge("imports", file_id, f"crate:{path}", path, g.line(m.start()))
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(struct|enum|trait|union)\s+(\w+)", code, re.M):
        end, _, _ = _block(g, code, m.start(), m.end())
        g.node("interface" if m.group(1) == "trait" else "class", m.group(2), g.line(m.start(2)), end, snippet=5)
    for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:\w+::)*(\w+)(?:<[^{]*?>)?\s+for\s+(?:\w+::)*(\w+)", code, re.M):
        g.edge("implements", f"{g.path}#{m.group(2)}", f"sym:{m.group(1)}", m.group(1), g.line(m.start()))
    for m in re.finditer(r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(\w+)", code, re.M):
        end, a, b = _block(g, code, m.start(), m.end())
        g.calls(g.node("function", m.group(1), g.line(m.start(1)), end), m.group(1), code[a:b], a)


def dart(g: Graph) -> None:
    code = mask(g.text, quotes="\"'", triple=True)
    file_id = f"file:{g.path}"
    for m in re.finditer(r"^\s*(import|export|part)\s+(['\"])", code, re.M):
        uri = g.text[m.end() : g.text.find(m.group(2), m.end())]
        rest = code[m.end() + len(uri) : code.find(";", m.end())]
        alias, shown = re.search(r"\bas\s+(\w+)", rest), re.search(r"\bshow\s+([\w,\s]+)", rest)
        package = uri.startswith(("package:", "dart:"))
        target = f"pkg:{uri}" if package else f"file:{resolve_path(g.path, uri)}"
        g.edge("imports", file_id, target, uri, g.line(m.start(1)), rawUri=uri, alias=alias and alias.group(1), shownSymbols=[s.strip() for s in shown.group(1).split(",")] if shown else [], isPackage=package)
    for m in re.finditer(r"^[ \t]*(?:(?:abstract|base|final|sealed|interface)\s+)*(class|mixin|enum|extension)\s+(\w+)([^{;]*)\{", code, re.M):
        end, _, _ = _block(g, code, m.start(), m.end() - 1)
        parts = dict(re.findall(r"\b(extends|with|implements)\s+((?:(?!\b(?:with|implements)\b)[^{])+)", m.group(3)))
        base = (names(parts.get("extends", "")) or [None])[0]
        id_ = g.node("class", m.group(2), g.line(m.start(1)), end, snippet=5, isWidget=bool(base and base.endswith("Widget") or base in ("State", "ConsumerState")), baseClass=base, mixins=names(parts.get("with", "")), implements=names(parts.get("implements", "")))
        for kind, listing in (("extends", [base] if base else []), ("implements", names(parts.get("implements", "")))):
            for b in listing:
                g.edge(kind, id_, f"sym:{b}", b, g.line(m.start(1)))
    _functions(g, code, r"^[ \t]*(?:(?:static|external|override|final|const)\s+)*(?:[\w<>?,\[\] ]+\s+)?(\w+)\s*(?:<[^()]*>)?\(", "function")
    for m in re.finditer(r"\bGoRoute\s*\(", code):
        if p := re.compile(r"path\s*:\s*(['\"])([^'\"]*)\1").search(g.text, m.end(), closing(code, m.end() - 1)):
            g.node("route", f"NAV {p.group(2)}", g.line(m.start()), g.line(m.start()), f"route:NAV:{p.group(2)}", 1, type="flutter_navigation", routePath=p.group(2))
    for m in re.finditer(r"^[ \t]*(?:final|const|var)\s+(?:[\w<>?, ]+\s+)?(\w+Provider)\s*=\s*([\w.]+)", code, re.M):
        g.node("variable", m.group(1), g.line(m.start(1)), g.line(m.start(1)), isProvider=True, providerType=m.group(2).split(".")[0])


def _functions(g: Graph, code: str, pattern: str, kind: str, skip: frozenset[str] = frozenset()) -> None:
    """Functions with bodies whose heads match ``pattern``: group 1 is the name, the match ends at its parenthesis."""
    stop = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "do", "try", "await", "using", "lock", "synchronized", "super", "this", "assert"} | skip
    for m in re.finditer(pattern, code, re.M):
        head = code[m.start() : m.start(1)].split()
        if m.group(1) in stop or (head and head[0] in {"return", "throw", "new", "else", "await", "case"}):
            continue
        close = closing(code, m.end() - 1)
        tail = re.match(r"\s*(?:const\b|noexcept\b|override\b|async\*?|throws\s+[\w.,\s]+|:\s*[\w<>?,.\[\]| \\&]+|->\s*[\w<>:&*\s]+)*\s*(\{|=>|=(?!=))", code[close + 1 :])
        if not tail:
            continue
        if tail.group(1) == "{":
            end, a, b = _block(g, code, m.start(), close + 1)
        else:
            a, b = close + 1, max(code.find(";", close), code.find("\n", close) if "\n" in code[close:] else len(code), close + 1)
            end = g.line(b - 1)
        g.calls(g.node(kind, m.group(1), g.line(m.start(1)), end), m.group(1), code[a:b], a)


def jvm(g: Graph) -> None:
    code = mask(g.text, quotes='"', triple=True)
    file_id = f"file:{g.path}"
    lang = "kotlin" if g.path.endswith((".kt", ".kts")) else "java"
    for m in re.finditer(r"^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)", code, re.M):
        g.edge("imports", file_id, f"pkg:{m.group(1)}", m.group(1).split(".")[-1], g.line(m.start(1)), importPath=m.group(1), language=lang)
    mods = r"(?:(?:public|private|protected|internal|abstract|final|open|sealed|static|data|inner|enum|annotation|strictfp|value|fun)\s+)*"
    for m in re.finditer(rf"^[ \t]*{mods}(@?interface|class|enum|record|object)\s+(\w+)([^{{\n;]*(?:\n[^{{;\n]*)?)", code, re.M):
        end, _, _ = _block(g, code, m.start(), m.end())
        head = re.sub(r"^\s*(?:<[^>]*>)?\s*(?:\([^)]*\))?", "", m.group(3))
        bases, faces = [], []
        if ":" in head and lang == "kotlin":
            bases = names(head.split(":", 1)[1])
        for word, listing in re.findall(r"\b(extends|implements|permits)\s+((?:(?!\b(?:extends|implements|permits)\b).)+)", head, re.S):
            (bases if word == "extends" else faces if word == "implements" else []).extend(names(listing))
        id_ = g.node("interface" if "interface" in m.group(1) else "class", m.group(2), g.line(m.start(1)), end, snippet=5, language=lang, bases=bases, implements=faces)
        for b in bases:
            if b not in ("Any", "Object"):
                g.edge("extends", id_, f"sym:{b}", b, g.line(m.start(1)))
    classes = [(m.start(), m.end()) for m in re.finditer(r"\bclass\s+\w+", code)]
    prefix = ""
    for m in re.finditer(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\b", code):
        q = re.match(r"\s*\(\s*(?:(?:value|path)\s*=\s*)?[{\[]?\s*\"([^\"]*)\"", g.text[m.end() :])
        where = q.group(1) if q else ""
        following = re.search(r"\bclass\b|\b(?:fun|public|private|protected)\b[^\n;{]*\(", code[m.end() :])
        if m.group(1) == "Request" and following and following.group().startswith("class") or any(code[m.end() : a].count(";") == 0 and "(" not in re.sub(r"@\w+\([^)]*\)", "", code[m.end() + (q.end() if q else 0) : a])[1:] for a, _ in classes if a > m.end() and m.group(1) == "Request"):
            prefix = where
            continue
        verb, full = m.group(1).upper(), "/".join(["", *[p for p in f"{prefix}/{where}".split("/") if p]])
        g.node("route", f"{verb} {full}", g.line(m.start()), g.line(m.start()), f"route:{verb}:{full}", 1, framework="spring_boot", method=verb, routePath=full)
    if lang == "kotlin":
        _functions(g, code, r"^[ \t]*(?:(?:public|private|protected|internal|override|open|suspend|inline|operator|final|abstract)\s+)*fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?(\w+)\s*\(", "function")
    else:
        _functions(g, code, r"^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]*>\s*)?[\w<>\[\]?,.]+(?:\s*<[^()]*>)?\s+(\w+)\s*\(", "function")


def php(g: Graph) -> None:
    code = mask(g.text, ("//", "#"), quotes="\"'")
    file_id = f"file:{g.path}"
    for m in re.finditer(r"^use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+(\w+))?\s*;", code, re.M):
        g.edge("imports", file_id, f"pkg:{m.group(1)}", m.group(2) or m.group(1).split("\\")[-1], g.line(m.start()), fullClass=m.group(1), alias=m.group(2) or m.group(1).split("\\")[-1])
    for m in re.finditer(r"\bRoute::(get|post|put|delete|patch|options|any|resource)\(\s*(['\"])", code):
        stop = g.text.find(m.group(2), m.end())
        verb, where, at = m.group(1).upper(), g.text[m.end() : stop], g.line(m.start())
        id_ = g.node("route", f"{verb} {where}", at, at, f"route:{verb}:{where}", 1, framework="laravel", method=verb, routePath=where)
        handler = re.match(r"\s*,\s*(?:\[\s*([\w\\]+)::class\s*,\s*['\"](\w+)['\"]|['\"]([\w\\]+)@(\w+)['\"])", g.text[stop + 1 :])
        if handler:
            controller, action = (handler.group(1) or handler.group(3)).split("\\")[-1], handler.group(2) or handler.group(4)
            g.edge("references", id_, f"sym:{controller}", controller, at, controller=controller, action=action)
    for m in re.finditer(r"^[ \t]*(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+(\w+)([^{;]*)", code, re.M):
        end, _, _ = _block(g, code, m.start(), m.end())
        parts = dict(re.findall(r"\b(extends|implements)\s+((?:(?!\b(?:extends|implements)\b)[^{])+)", m.group(3)))
        bases, faces = ([b.split("\\")[-1] for b in names(parts.get(k, ""))] for k in ("extends", "implements"))
        id_ = g.node("interface" if m.group(1) == "interface" else "class", m.group(2), g.line(m.start(1)), end, snippet=5, baseClass=(bases or [None])[0], implements=faces)
        for b in bases:
            g.edge("extends", id_, f"sym:{b}", b, g.line(m.start(1)))
    for m in re.finditer(r"\bfunction\s+&?(\w+)\s*\(", code):
        end, a, b = _block(g, code, m.start(), m.end())
        id_ = g.node("function", m.group(1), g.line(m.start()), end)
        g.calls(id_, m.group(1), code[a:b], a)
        if r := re.search(r"->(hasOne|hasMany|belongsTo|belongsToMany|morphTo|morphMany|morphOne|hasManyThrough)\(\s*\\?([\w\\]+)::class", code[a:b]):
            model = r.group(2).split("\\")[-1]
            g.edge("references", id_, f"sym:{model}", model, g.line(a + r.start()), isEloquentRelation=True, relationType=r.group(1), targetModel=model)


# Scalar types of the schema language.
SCALARS = set("String Int Float Boolean DateTime Json Bytes Decimal BigInt".split())


def prisma(g: Graph) -> None:
    code = mask(g.text, quotes='"')
    for m in re.finditer(r"^[ \t]*(model|enum)[ \t]+(\w+)[ \t]*\{", code, re.M):
        end, a, b = _block(g, code, m.start(), m.end() - 1)
        start, fields = g.line(m.start()), []
        if m.group(1) == "enum":
            g.node("type", m.group(2), start, end, isDatabaseEnum=True, schemaType="prisma")
            continue
        for f in re.finditer(r"^[ \t]*(\w+)[ \t]+(\w+)(\[\]|\?)?", code[a + 1 : b], re.M):
            relation = f.group(2) not in SCALARS and f.group(2)[0].isupper()
            fields.append({"name": f.group(1), "type": f.group(2) + (f.group(3) or ""), "isRelation": relation, "relationTarget": f.group(2) if relation else None, "at": a + 1 + f.start(1)})
        id_ = g.node("class", m.group(2), start, end, snippet=5, isDatabaseModel=True, schemaType="prisma", fieldsCount=len(fields), fields=[{k: v for k, v in f.items() if k != "at"} for f in fields])
        for f in fields:
            if f["isRelation"]:
                g.edge("references", id_, f"sym:{f['relationTarget']}", f["relationTarget"], g.line(f["at"]), relationField=f["name"], targetModel=f["relationTarget"], isPrismaRelation=True)


def sql(g: Graph) -> None:
    code = mask(g.text, ("--",), quotes="'")
    for m in re.finditer(r"\bcreate\s+(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)\s*\(", code, re.I):
        depth, at, cuts, end = 1, m.end(), [m.end()], len(code)
        for q in re.finditer(r"[(),]", code[m.end() :]):
            k = m.end() + q.start()
            depth += {"(": 1, ")": -1}.get(q.group(), 0)
            if not depth:
                end = k
                break
            if q.group() == "," and depth == 1:
                cuts.append(k + 1)
        name = re.sub(r'["`\[\]]', "", m.group(1)).split(".")[-1]
        columns, keys = [], []
        for at, stop in zip(cuts, [*[c - 1 for c in cuts[1:]], end]):
            item = code[at:stop]
            ref = re.search(r"\breferences\s+([\w.\"`\[\]]+)\s*(?:\(\s*([^)]*)\))?", item, re.I)
            fk = re.search(r"\bforeign\s+key\s*\(\s*([^)]*)\)", item, re.I)
            first = re.match(r"\s*[\"`\[]?(\w+)", item)
            if not fk and first and first.group(1).upper() not in {"PRIMARY", "UNIQUE", "CHECK", "CONSTRAINT", "KEY", "INDEX", "FOREIGN", "EXCLUDE"}:
                columns.append(first.group(1))
            if ref:
                source = re.sub(r'["`\s]', "", fk.group(1)) if fk else first.group(1)
                keys.append({"column": source, "targetTable": re.sub(r'["`\[\]]', "", ref.group(1)).split(".")[-1], "targetColumn": (ref.group(2) or "").strip() or None, "at": at + ref.start()})
        id_ = g.node("class", name, g.line(m.start()), g.line(end - 1 if end == len(code) else end), snippet=5, isSqlTable=True, columnsCount=len(columns), columns=columns, foreignKeys=[{k: v for k, v in f.items() if k != "at"} for f in keys])
        for f in keys:
            g.edge("references", id_, f"sym:{f['targetTable']}", f["targetTable"], g.line(f["at"]), isForeignKey=True, sourceColumn=f["column"], targetTable=f["targetTable"], targetColumn=f["targetColumn"])


def markdown(g: Graph) -> None:
    heads, fence = [], False
    for k, row in enumerate(g.lines, 1):
        row = row.rstrip("\r")
        if row.lstrip().startswith(("```", "~~~")):
            fence = not fence
        elif not fence and (m := re.match(r"(#{1,6})\s+(.+?)\s*#*$", row)):
            heads.append((k, len(m.group(1)), m.group(2)))
    for i, (k, level, title) in enumerate(heads):
        end = next((a - 1 for a, other, _ in heads[i + 1 :] if other <= level), len(g.lines))
        slug = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-")
        id_ = g.node("doc_section", title, k, end, f"{g.path}#section:{slug}", headingLevel=level)
        seen: dict[str, int] = {}
        for j in range(k - 1, min(end, k + 149)):
            for m in re.finditer(r"`([A-Za-z_$][\w$.]*)(?:\(\))?`", g.lines[j]):
                word = m.group(1).split(".")[-1]
                if len(word) > 2 and word not in ("true", "false", "null", "undefined", "const", "let", "var", "function", "class"):
                    seen.setdefault(word, j + 1)
        for word, at in list(seen.items())[:25]:
            g.edge("documents", id_, f"sym:{word}", word, at, "inferred")


def c_style(g: Graph) -> None:
    ruby = g.path.endswith(".rb")
    code = mask(g.text, ("#",) if ruby else ("//",), None if ruby else ("/*", "*/"), "\"'" if ruby else '"')
    for m in re.finditer(r"^[ \t]*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|final|export)\s+)*(class|struct|interface|trait|record|module)\s+(\w+)(?:\s*(?::|<)\s*([^{\n;]+))?", code, re.M):
        end, _, _ = _block(g, code, m.start(), m.end())
        id_ = g.node("interface" if m.group(1) in ("interface", "trait") else "class", m.group(2), g.line(m.start(1)), end, snippet=5)
        for b in names(re.sub(r"\b(?:public|private|protected|virtual)\s+", "", m.group(3) or "")):
            g.edge("extends", id_, f"sym:{b}", b, g.line(m.start(1)))
    if ruby:
        for m in re.finditer(r"^([ \t]*)def\s+(?:self\.)?(\w+[?!]?)[^\n]*\n(.*?)^\1end\b", code, re.M | re.S):
            id_ = g.node("method", m.group(2), g.line(m.start(2)), g.line(m.end() - 1))
            g.calls(id_, m.group(2), m.group(3), m.start(3))
        return
    _functions(g, code, r"^[ \t]*(?:(?:public|private|protected|internal|static|virtual|override|async|inline|constexpr|extern|sealed|abstract|unsafe)\s+)*[\w<>\[\]?,.:&*]+(?:\s*<[^()]*>)?[\s&*]+(?:\w+::)*~?(\w+)\s*\(", "method")
