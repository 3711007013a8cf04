"""TypeScript, JavaScript and single-file components: a recursive descent over tokens that keeps declarations, calls and routes."""

from __future__ import annotations

import bisect
import re
import sys

from quillgraph.parse.base import Graph, resolve_path
from quillgraph.parse.lexer import Lexer

# Reserved words, which are never called.
RESERVED = set("if for while switch catch return typeof new delete void throw instanceof in of yield await function class interface extends implements super this require import export from as const let var async".split())
# Calls of these properties are not followed.
QUIET = set(
    "then catch finally apply call bind push pop map filter reduce forEach slice splice concat join split indexOf includes startsWith endsWith toString toUpperCase toLowerCase trim replace match search "
    "substring substr charAt charCodeAt keys values entries has get set add delete clear sort reverse length".split()
)
# Properties whose call with a path is a route.
VERBS = set("get post put delete patch options all".split())
TYPE_WORDS = set("keyof typeof unique readonly infer asserts new abstract -".split())
MODIFIERS = set("public private protected static readonly abstract override declare async accessor get set".split())
PREFIX = set("await typeof void delete yield".split())
#: Punctuation that ends an expression.
ENDS = set(") ] } , ; : =>".split())
#: Words that begin an operand of more than themselves.
OPERAND_WORDS = PREFIX | set("function class new async".split())
UNARY = set("+ - ! ~ ++ -- ... & | * / % = >".split())
#: Words that begin a statement, or a part of one.
STATEMENT_WORDS = set(
    "import class interface type enum const namespace module global function var let if while with switch for do try finally else catch return throw break continue debugger case default export declare abstract async".split()
)
#: What a function as a value begins with, unless an arrow comes next.
FUNCTION_WORDS = set("( < async function".split())
LEAVING = set("return throw break continue debugger".split())
#: Ends behind the last token: as many as are looked at ahead of one.
BEHIND = 8
DEEPEST = 12_000


class Reader:
    """Reads a part of a file that begins at ``offset``. Declarations become nodes, calls edges of all functions that hold them."""

    def __init__(self, g: Graph, text: str, offset: int, jsx: bool):
        self.g, self.text, self.offset, self.jsx = g, text, offset, jsx
        lexer = Lexer(text, jsx)
        self.n = len(lexer.kinds)
        self.kinds, self.texts = lexer.kinds + ["end"] * BEHIND, lexer.texts + [""] * BEHIND
        self.fresh, self.pair, self.starts, self.numbers = lexer.fresh, lexer.pair, lexer.starts, lexer.numbers
        self.ats: list[int] | None = None
        self.i = 0
        self.first = g.line(offset)
        self.callers: list[str] = []
        self.depth = 0  # of blocks: imports count at 0 only

    # --- tokens, by their numbers

    def word(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.texts[k] if k < self.n else ""

    def kind(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.kinds[k] if k < self.n else "end"

    def newline(self, ahead: int = 0) -> bool:
        """Whether a line break is before a token."""
        k = self.i + ahead
        return k in self.fresh or k >= self.n

    def at(self, *texts: str) -> bool:
        i = self.i
        return i < self.n and self.texts[i] in texts

    def take(self) -> str:
        i = self.i
        self.i = i + 1
        return self.texts[i] if i < self.n else ""

    def skip(self, *texts: str) -> bool:
        i = self.i
        if i < self.n and self.texts[i] in texts:
            self.i = i + 1
            return True
        return False

    def line(self, k: int) -> int:
        return self.first + (self.numbers[bisect.bisect_right(self.starts, k) - 1] if k < self.n else 0)

    def last_line(self) -> int:
        k = min(self.i, self.n) - 1
        return self.line(k) + self.texts[k].count("\n", 0, -1)

    def close(self, k: int | None = None) -> int:
        """The place of the bracket that closes the one at ``k``."""
        return self.pair.get(self.i if k is None else k, self.n)

    def leave(self, k: int) -> None:
        """Go behind the bracket at ``k``."""
        n = self.n
        self.i = k + 1 if k < n else n

    def source(self, a: int, b: int) -> str:
        """The text from one token to the end of another, ends asked for rarely: a second run of the lexer tells the places."""
        if self.ats is None:
            self.ats = Lexer(self.text, self.jsx, 0).ats
        return self.text[self.ats[a] : self.ats[b] + len(self.texts[b])]

    # --- rows

    def called(self, name: str, dotted: bool, start: int, new: bool = False) -> None:
        callers = self.callers
        if not callers or not name or name in RESERVED or (dotted and not new and name in QUIET):
            return
        line, edge, target, infix = self.line(start), self.g.edge, f"sym:{name}", "new:" if new else ""
        for caller in dict.fromkeys(callers) if len(callers) > 1 else callers:
            edge("calls", caller, target, name, line, "exact", infix)

    def node(self, kind: str, name: str, start: int, **more) -> str:
        return self.g.node(kind, name, self.line(start), self.last_line(), **more)

    def holding(self, name: str, start: int, body) -> None:
        """A function's node, and what ``body`` reads as its calls. The node is made before those within."""
        before, id_ = self.i, f"{self.g.path}#{name}"
        fresh = id_ not in self.g.nodes
        if fresh:
            self.g.node("function", name, self.line(start), self.line(start))
        self.callers.append(id_)
        body()
        self.callers.pop()
        if fresh and self.i > before:
            row, last = self.g.nodes[id_], self.last_line()
            first = row[4]
            if last > first:  # else the row is right as it is
                code = "\n".join(self.g.lines[first - 1 : min(last, first + 6)])
                self.g.nodes[id_] = (*row[:5], last, code, *row[7:])

    # --- types

    def angle(self) -> bool:
        """Skip type arguments or parameters; False, at the same place, if they are none."""
        i, n, depth, texts, kinds = self.i, self.n, 0, self.texts, self.kinds
        while i < n:
            i += 1
            if kinds[i - 1] == "punct":
                t = texts[i - 1]
                if t in "([{":
                    i = min(self.pair.get(i - 1, n) + 1, n)
                elif t == "<":
                    depth += 1
                elif t == ">":
                    depth -= 1
                    if not depth:
                        self.i = i
                        return True
                elif t not in (",", "=>", "=", "|", "&", ".", "?", ":", "-", "..."):
                    break
        return False

    def type(self) -> None:
        """Skip a type."""
        texts, kinds, fresh, n = self.texts, self.kinds, self.fresh, self.n
        if self.i >= n:
            return
        if texts[self.i] in ("|", "&"):
            self.i += 1
        while True:
            while texts[self.i] in TYPE_WORDS and texts[self.i + 1] not in (",", ")", ";", "=", "|", "&", ">"):
                self.i += 1
            if texts[self.i] == "<":
                self.angle()
            i = self.i
            t = texts[i]
            if t == "(" or t == "{" or t == "[":
                self.leave(self.close())
                if t == "(" and texts[self.i] == "=>":
                    self.i += 1
                    self.type()
                    return
            elif kinds[i] in ("name", "string", "number"):
                i += 1
                while texts[i] == "." and kinds[i + 1] == "name":
                    i += 2
                self.i = i
                if texts[i] == "(" and texts[i - 1] == "import":
                    self.leave(self.close())
                    continue
                if texts[i] == "<":
                    self.angle()
            else:
                return
            while texts[self.i] == "[" and self.i not in fresh:
                self.leave(self.close())
            i = self.i
            t = texts[i]
            if t == "." and kinds[i + 1] == "name":
                self.i += 1
                continue
            if t == "is" and i not in fresh or t in ("|", "&"):
                self.i += 1
                continue
            if t == "extends" and i not in fresh:
                self.i += 1
                self.type()
                if self.skip("?"):
                    self.type()
                    self.skip(":")
                    continue
            return

    # --- statements

    def statements(self, end: int) -> None:
        end = min(end, self.n)
        while self.i < end:
            before = self.i
            self.statement()
            if self.i == before:
                self.i += 1
        self.i = end

    def block(self) -> None:
        """A block in braces."""
        end = self.pair.get(self.i, self.n)
        self.i += 1
        if self.i < end:
            self.depth += 1
            self.statements(end)
            self.depth -= 1
        self.leave(end)

    def decorators(self) -> None:
        while self.i < self.n and self.texts[self.i] == "@":
            self.i += 1
            self.operand()

    def statement(self) -> None:
        start, texts, kinds = self.i, self.texts, self.kinds
        if start >= self.n:
            return
        t = texts[start]
        if t not in STATEMENT_WORDS and t not in (";", "{", "@"):
            if kinds[start] == "name" and texts[start + 1] == ":":  # a label
                self.i += 2
            else:
                self.expression(True)
                self.skip(";")
            return
        if t in LEAVING:
            self.left()
            return
        if t == "const" and texts[start + 1] != "enum":
            self.i = start + 1
            self.variables(start)
            return
        if t == "function":
            self.function(start, True)
            return
        self.decorators()
        if self.at("export"):
            self.i += 1
            if self.at("{", "*"):
                self.until_semicolon()
                return
            self.skip("default", "=")
        while self.at("declare", "abstract", "async") and self.kind(1) == "name" and not self.newline(1) and self.word(1) in ("class", "function", "abstract", "async", "const", "let", "var", "namespace", "module", "enum", "interface", "type", "global", "export"):
            self.i += 1
        self.decorators()
        t, kind, after, after_kind = self.word(), self.kind(), self.word(1), self.kind(1)
        word = t if kind == "name" else ""
        if t == ";":
            self.i += 1
        elif t == "{":
            self.block()
        elif word not in STATEMENT_WORDS:
            if word and after == ":":
                self.i += 2
            else:
                self.expression(True)
                self.skip(";")
        elif word == "import" and after not in ("(", "."):
            self.imported(start)
        elif word == "class":
            self.a_class(start, True)
        elif word == "interface" and after_kind == "name" and not self.newline(1):
            self.interface(start)
        elif word == "type" and after_kind == "name" and not self.newline(1) and self.word(2) in ("=", "<"):
            self.i += 2
            if self.at("<"):
                self.angle()
            self.skip("=")
            self.type()
        elif word == "enum" or (word == "const" and after == "enum"):
            self.i += 3 if word == "const" else 2
            end = self.close()
            self.i += 1
            while self.i < end:
                before = self.i
                self.expression(True)
                self.i += self.i == before
            self.leave(end)
        elif word in ("namespace", "module", "global") and (after_kind in ("name", "string") and not self.newline(1) or word == "global" and after == "{"):
            self.i += 1
            while not self.at("{", ";") and self.i < self.n:
                self.i += 1
            if self.at("{"):
                self.block()
        elif word == "function":
            self.function(start, True)
        elif word in ("var", "const") or (word == "let" and (after_kind == "name" or after in ("[", "{"))):
            self.i += 1
            self.variables(start)
        elif word in ("if", "while", "with", "switch", "for"):
            self.i += 1
            self.skip("await")
            if self.at("("):
                end = self.close()
                self.i += 1
                self.head(end)
                self.leave(end)
            if word == "switch" and self.at("{"):
                self.block()
            else:
                self.statement()
                if word == "if" and self.skip("else"):
                    self.statement()
        elif word in ("do", "try", "finally", "else"):
            self.i += 1
            self.statement()
        elif word == "catch":
            self.i += 1
            if self.at("("):
                self.leave(self.close())
            self.statement()
        elif word in LEAVING:
            self.left()
        elif word == "case" or (word == "default" and after == ":"):
            self.i += 1
            if word == "case":
                self.expression(True)
            self.skip(":")
        elif word and after == ":":  # a label
            self.i += 2
        else:
            self.expression(True)
            self.skip(";")

    def left(self) -> None:
        """A statement that leaves its block, with the value it gives."""
        self.i += 1
        if not self.newline() and not self.at(";", "}"):
            self.expression(True)
        self.skip(";")

    def until_semicolon(self) -> None:
        """Skip an export list or an import."""
        while self.i < self.n:
            kind, t = self.kind(), self.take()
            if t == "{":
                self.leave(self.close(self.i - 1))
            if t == ";" or (kind == "string" and not self.at("with", "assert")):
                break
            if self.newline() and not self.at("from", ",") and t not in ("from", ",", "*", "as"):
                break
        self.skip(";")

    def head(self, end: int) -> None:
        """What stands in the parentheses of a statement."""
        while self.i < end:
            before = self.i
            if self.at("var", "let", "const"):
                self.i += 1
                self.variables(self.i - 1)
            elif not self.skip(";", "of", "in"):
                self.expression(True)
            if self.i == before:
                self.i += 1

    def imported(self, start: int) -> None:
        self.i += 1
        type_only = self.at("type") and self.word(1) not in (",", "from", "=")
        self.i += type_only
        default, named, namespace = "", [], False
        if self.kind() == "name" and self.word(1) == "=":  # import x = require("y"), import x = A.B
            self.i += 2
            self.expression(False)
            self.skip(";")
            return
        if self.kind() == "name" and not self.at("from") or self.at("from") and self.word(1) == "from":
            default = self.take()
            self.skip(",")
        if self.skip("*"):
            self.skip("as")
            namespace = True
            self.i += 1
        elif self.at("{"):
            end = self.close()
            self.i += 1
            while self.i < end:
                words = []
                while self.i < end and not self.at(","):
                    words.append(self.take())
                self.i += 1
                words = words[1:] if len(words) > 1 and words[0] == "type" and words[1] != "as" else words
                named += words[:1]
            self.leave(end)
        self.skip("from")
        if self.kind() == "string":
            self.link(self.take()[1:-1], start, importedSymbols=named, isNamespace=namespace, defaultImport=default or None)
            if self.skip("with", "assert") and self.at("{"):
                self.leave(self.close())
        self.skip(";")

    def link(self, target: str, start: int, **meta) -> None:
        if self.depth:
            return
        path = resolve_path(self.g.path, target) if target.startswith(".") else target
        self.g.edge("imports", f"file:{self.g.path}", f"file:{path}", target, self.line(start), **{"importedSymbols": meta.pop("importedSymbols"), "rawImportPath": target, "resolvedModulePath": path, **meta})

    def variables(self, start: int) -> None:
        """Declarators; one whose value is a function is a node."""
        texts, kinds, n = self.texts, self.kinds, self.n
        while True:
            at = i = self.i
            simple = i < n and kinds[i] == "name"
            if simple:
                name, symbols = texts[i], [texts[i]]
                self.i = i = i + 1
            else:
                symbols = self.pattern()
                i = min(self.i, n)
            if texts[i] == "!":
                self.i = i = i + 1
            if texts[i] == ":":
                self.i = i + 1
                self.type()
                i = self.i
            if texts[i] == "=":
                self.i = i = i + 1
                if texts[i] == "require" and texts[i + 1] == "(" and kinds[i + 2] == "string" and texts[i + 3] in (")", ","):
                    self.link(texts[i + 2][1:-1], start, importedSymbols=symbols, isRequire=True)
                if simple and (texts[i] in FUNCTION_WORDS or texts[i + 1] == "=>") and self.function_ahead():
                    self.holding(name, at, lambda: self.expression(False))
                else:
                    self.expression(False)
            if not self.skip(","):
                break
        self.skip(";")

    def function_ahead(self) -> bool:
        """Whether the value here is an arrow function or a function expression and nothing more."""
        k, texts, kinds, n = self.i, self.texts, self.kinds, self.n
        if k >= n:
            return False
        if self.arrow_ahead():
            return True
        if texts[k] == "async" and texts[k + 1] == "function":
            k += 1
        if texts[k] != "function":
            return False
        while k < n and texts[k] != "(":
            k += 1
        k = self.close(k) + 1
        if k < n and texts[k] == ":":
            saved, self.i = self.i, k + 1
            self.type()
            k, self.i = self.i, saved
        after = self.close(k) + 1
        if after >= n:
            return True
        t = texts[after]
        return kinds[after] != "punct" or t in ENDS or t == ";" or (after in self.fresh and t not in (".", "(", "[", "?."))

    def pattern(self) -> list[str]:
        """A binding pattern: its names; defaults are read."""
        if not self.at("{", "["):
            return [self.take()] if self.kind() == "name" else []
        braces, end, found = self.at("{"), self.close(), []
        self.i += 1
        while self.i < end:
            before = self.i
            self.skip("...")
            if self.at("[") and braces:
                self.i += 1
                self.expression(True)
                self.skip("]")
                found += self.pattern() if self.skip(":") else []
            elif self.at("{", "["):
                found += self.pattern()
            elif self.kind() in ("name", "string", "number"):
                key = self.take()
                found += self.pattern() if braces and self.skip(":") else [key]
            if self.skip("="):
                self.expression(False)
            self.skip(",")
            self.i += self.i == before
        self.leave(end)
        return found

    def parameters(self) -> None:
        """Parameters in parentheses; decorators and defaults are read."""
        n, texts, kinds = self.n, self.texts, self.kinds
        end = self.pair.get(self.i, n)
        self.i += 1
        while self.i < end:
            before = i = self.i
            if texts[i] == "@":
                self.decorators()
                i = min(self.i, n)
            while kinds[i] == "name" and (kinds[i + 1] == "name" or texts[i + 1] in ("{", "[")):
                i += 1  # modifiers
            if texts[i] == "...":
                i += 1
            self.i = i
            if kinds[i] == "name":
                self.i = i = i + 1
            else:
                self.pattern()
                i = self.i
            if texts[i] == "?":
                self.i = i = i + 1
            if texts[i] == ":":
                self.i = i + 1
                self.type()
                i = self.i
            if texts[i] == "=":
                self.i = i + 1
                self.expression(False)
                i = min(self.i, n)
            if texts[i] == ",":
                self.i = i + 1
            self.i += self.i == before
        self.leave(end)

    def signature(self) -> None:
        """Type parameters, parameters and the type of what a function returns."""
        i, n, texts = self.i, self.n, self.texts
        if i < n and texts[i] == "<":
            self.angle()
            i = self.i
        if i < n and texts[i] == "(":
            self.parameters()
            i = self.i
        if i < n and texts[i] == ":":
            self.i = i + 1
            self.type()

    def function(self, start: int, declared: bool) -> None:
        self.i += 1
        self.skip("*")
        name = self.take() if self.kind() == "name" else ""

        def body() -> None:
            if self.at("{"):
                self.block()
            elif declared:
                self.skip(";")

        if not (declared and name):
            self.signature()
            body()
            return

        def rest() -> None:
            hidden = self.callers.pop()  # the parameters are not of the body
            self.signature()
            self.callers.append(hidden)
            body()

        self.holding(name, start, rest)

    def heritage(self) -> list[tuple[str, str]]:
        """(kind, base) of what a class or an interface builds on."""
        found = []
        while self.at("extends", "implements"):
            kind = self.take()
            while not self.at("{", "implements", "extends") and self.i < self.n:
                before = self.i
                base = self.word() if self.kind() == "name" else ""
                if kind == "implements":
                    self.type()
                else:
                    self.operand(heritage=True)
                if base:
                    found.append((kind, base))
                if self.at("<"):
                    self.angle()
                self.skip(",")
                self.i += self.i == before
        return found

    def a_class(self, start: int, declared: bool) -> None:
        self.i += 1
        name = ""
        if self.kind() == "name" and not self.at("extends", "implements"):
            name = self.take()
        if self.at("<"):
            self.angle()
        bases = self.heritage()
        end = self.close()
        if declared and name:
            after = self.i
            self.leave(end)
            id_ = self.node("class", name, start, snippet=5)
            self.i = after
            for kind, base in bases:
                self.g.edge(kind, id_, f"sym:{base}", base, self.line(start))
        if self.at("{"):
            self.members(end)

    def interface(self, start: int) -> None:
        self.i += 1
        name = self.take()
        if self.at("<"):
            self.angle()
        bases = []
        if self.skip("extends"):
            while not self.at("{") and self.i < self.n:
                before = self.i
                bases.append(self.word())
                self.type()
                self.skip(",")
                self.i += self.i == before
        if self.at("{"):
            self.leave(self.close())
        id_ = self.node("interface", name, start, snippet=5)
        for base in bases:
            self.g.edge("extends", id_, f"sym:{base}", base, self.line(start))

    def key(self) -> str:
        """A member's name as it is written; a computed one is read."""
        if self.at("["):
            first = self.i
            end = self.close()
            self.i += 1
            self.expression(True)
            self.leave(end)
            return self.source(first, min(end, self.n - 1))
        return self.take()

    def accessor_or_modifiers(self, words: set[str]) -> bool:
        """Skip modifiers; whether the member is a getter or setter."""
        accessor, texts, kinds, n = False, self.texts, self.kinds, self.n
        while True:
            if self.i < n and texts[self.i] == "@":
                self.decorators()
            i = self.i
            if i >= n:
                return accessor
            t = texts[i]
            if t == "*":
                self.i += 1
                continue
            after = kinds[i + 1]
            if t in words and not (after == "punct" and texts[i + 1] not in ("[", "*", "{") or after == "end") and not (texts[i + 1] == "{" and t != "static"):
                accessor = accessor or t in ("get", "set")
                self.i += 1
                continue
            return accessor

    def members(self, end: int) -> None:
        self.i += 1
        self.depth += 1
        while self.i < end:
            before = start = self.i
            if self.skip(";", ","):
                continue
            accessor = self.accessor_or_modifiers(MODIFIERS)
            if self.at("{"):  # static block
                self.block()
                continue
            if self.at("[") and self.kind(1) == "name" and self.word(2) == ":":  # index signature
                self.leave(self.close())
                if self.skip(":"):
                    self.type()
                continue
            name = self.key()
            self.skip("?", "!")
            if self.at("(", "<"):
                self.method(name, start, accessor)
            else:
                if self.skip(":"):
                    self.type()
                if self.skip("="):
                    self.expression(False)
            self.i += self.i == before
        self.depth -= 1
        self.leave(end)

    def method(self, name: str, start: int, accessor: bool) -> None:
        def rest() -> None:
            hidden = None if accessor or name == "constructor" else self.callers.pop()
            self.signature()
            if hidden:
                self.callers.append(hidden)
            if self.at("{"):
                self.block()
            else:
                self.skip(";")

        if accessor or name == "constructor":
            rest()
        else:
            self.holding(name, start, rest)

    # --- expressions

    def expression(self, commas: bool, in_branch: bool = False) -> None:
        """Operands and what joins them, up to a token that ends an expression."""
        texts, kinds, n = self.texts, self.kinds, self.n
        while True:
            i = self.i
            if i < n and texts[i + 1] in ENDS and (kinds[i] == "name" and texts[i] not in OPERAND_WORDS or kinds[i] in ("string", "number")) and texts[i + 1] != "=>":
                self.i = i + 1  # one token alone
            else:
                self.operand(in_branch)
            i = self.i
            if i >= n:
                return
            kind, t = kinds[i], texts[i]
            if kind == "name":
                if t in ("in", "instanceof") or (t == "of" and i not in self.fresh):
                    self.i += 1
                    continue
                if t in ("as", "satisfies") and i not in self.fresh:
                    self.i += 1
                    self.type()
                    kind, t = self.kind(), self.word()
                    if kind == "punct" and t not in ENDS and t not in ("{", "?"):
                        self.i += 1
                        continue
                    if t not in (",", "?"):
                        return
                else:
                    return
            elif kind != "punct":
                return
            if t == ",":
                if not commas:
                    return
                self.i += 1
            elif t == "?":
                self.i += 1
                self.expression(False, True)
                if self.skip(":"):
                    self.expression(False, in_branch)
                if not (commas and self.at(",")):
                    return
            elif t in ENDS or t == "{" or t == "@":
                return
            else:
                self.i += 1

    def arrow_ahead(self, in_branch: bool = False) -> bool:
        """Whether an arrow function begins here."""
        k, texts, kinds, n = self.i, self.texts, self.kinds, self.n
        if k >= n:
            return False
        if texts[k] == "async" and k + 1 not in self.fresh and (kinds[k + 1] == "name" and texts[k + 2] == "=>" or texts[k + 1] in ("(", "<")):
            k += 1
        if kinds[k] == "name":
            return texts[k + 1] == "=>"
        if texts[k] not in ("(", "<"):
            return False
        saved, found, self.i = self.i, False, k
        if texts[k] == "(" or self.angle():
            if self.at("("):
                self.leave(self.close())
                found = self.at("=>")
                if not found and not in_branch and self.at(":"):
                    self.i += 1
                    self.type()
                    found = self.at("=>")
        self.i = saved
        return found

    def arrow(self) -> None:
        if self.at("async") and self.word(1) != "=>":
            self.i += 1
        if self.kind() == "name":
            self.i += 1
        else:
            self.signature()
        self.skip("=>")
        if self.at("{"):
            self.block()
        else:
            self.expression(False)

    def elements(self) -> None:
        """Comma-separated expressions in a pair of brackets."""
        n = self.n
        end = self.pair.get(self.i, n)
        self.i += 1
        if self.i < end:
            self.depth += 1
            while self.i < end:
                before = self.i
                self.expression(True)
                self.i += self.i == before
            self.depth -= 1
        self.i = end + 1 if end < n else n

    def object(self) -> None:
        end = self.close()
        self.i += 1
        self.depth += 1
        while self.i < end:
            before = start = self.i
            if self.skip(","):
                continue
            if self.skip("..."):
                self.expression(False)
                continue
            accessor = self.accessor_or_modifiers({"async", "get", "set"})
            name = self.key()
            if self.at("(", "<"):
                self.method(name, start, accessor)
            elif self.skip(":", "="):
                self.expression(False)
            self.i += self.i == before
        self.depth -= 1
        self.leave(end)

    def operand(self, in_branch: bool = False, heritage: bool = False) -> None:
        """One operand with what is called and read of it."""
        texts, kinds, fresh, n = self.texts, self.kinds, self.fresh, self.n
        i = self.i
        while True:
            if i >= n:
                self.i = i
                return
            kind, t = kinds[i], texts[i]
            if kind == "name" and t in PREFIX and texts[i + 1] not in (":", "=>"):
                i += 1
                if t == "yield":
                    i += texts[i] == "*"
                    if i in fresh or i >= n or texts[i] in ENDS:
                        self.i = i
                        return
            elif kind == "punct" and t in UNARY:
                i += 1
            else:
                break
        self.i = start = i
        name, dotted = "", False
        if kind == "name":
            if texts[i + 1] == "=>" or (t == "async" and self.arrow_ahead(in_branch)):
                self.arrow()
                return
            if t == "function" or (t == "async" and texts[i + 1] == "function" and i + 1 not in fresh):
                self.i += t == "async"
                self.function(start, False)
            elif t == "class":
                self.a_class(start, False)
            elif t == "new":
                self.new(start)
            else:
                self.i += 1
                name = "" if t == "import" else t
        elif kind != "punct":
            self.i += 1
        elif t in ENDS:
            return
        elif t == "(" or t == "<":
            if self.arrow_ahead(in_branch):
                self.arrow()
                return
            if t == "<":
                if not self.angle():  # else a cast
                    self.i += 1
                self.operand(in_branch)
                return
            self.elements()
        elif t == "[":
            self.elements()
        elif t == "{":
            if heritage:
                return
            self.object()
        elif t == "@":
            self.decorators()
            return
        else:
            self.i += 1
        while True:
            i = self.i
            if i >= n:
                return
            t = texts[i]
            if kinds[i] != "punct":
                if kinds[i] == "string" and t[:1] == "`" and i not in fresh:  # a tagged template
                    self.i += 1
                    name = ""
                    continue
                return
            if t == "." or t == "?.":
                self.i += 1
                if kinds[i + 1] == "name":
                    self.i += 1
                    name, dotted = texts[i + 1], True
            elif t == "(":
                self.call(name, dotted, start)
                name, dotted = "", False
            elif t == "[":
                self.elements()
                name = ""
            elif t == "!" and i not in fresh and texts[i + 1] != "=":
                self.i += 1
                name = ""
            elif t == "<" and not heritage and (name or dotted):
                if not (self.angle() and self.at("(")):
                    self.i = i
                    return
            elif t in ("++", "--") and i not in fresh:
                self.i += 1
            else:
                return

    def new(self, start: int) -> None:
        self.i += 1
        if self.at("."):
            self.i += 2
            return
        name = ""
        if self.kind() == "name":
            name = self.take()
            if name == "new":
                self.i -= 1
                self.new(self.i)
                name = ""
            elif name == "class":
                self.i -= 1
                self.a_class(start, False)
                name = ""
        elif self.at("("):
            self.elements()
        while True:
            if self.at(".", "?.") and self.kind(1) == "name":
                self.i += 1
                name = self.take()
            elif self.at("["):
                self.elements()
                name = ""
            else:
                break
        if self.at("<"):
            saved = self.i
            if not (self.angle() and self.at("(")):
                self.i = saved
        self.called(name, False, start, new=True)
        if self.at("("):
            self.elements()

    def call(self, name: str, dotted: bool, start: int) -> None:
        if name:
            if self.callers:
                self.called(name, dotted, start)
            if dotted and name in VERBS and self.kind(1) == "string":
                self.route(name.upper(), self.word(1)[1:-1], start)
        self.elements()

    def route(self, verb: str, path: str, start: int) -> None:
        at, end = self.line(start), self.close()
        id_ = self.g.node("route", f"{verb} {path}", at, at, f"route:{verb}:{path}", 1, method=verb, routePath=path)
        last = end - (2 if end - 1 < self.n and self.texts[end - 1] == "," else 1)
        if self.i + 2 < last < self.n and self.kinds[last] == "name":
            handler = self.texts[last]
            self.g.edge("references", id_, f"{self.g.path}#{handler}", handler, at)


def parse_script(g: Graph, text: str | None = None, offset: int = 0) -> None:
    """Imports, declarations, calls and routes. ``text`` is a part of the file that begins at ``offset``."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, DEEPEST))
    try:
        reader = Reader(g, g.text if text is None else text, offset, not g.path.endswith((".ts", ".mts", ".cts")))
        reader.statements(reader.n)
    finally:
        sys.setrecursionlimit(limit)


def parse_component(g: Graph) -> None:
    """A Vue or Svelte file: its scripts, and the component as a class."""
    for m in re.finditer(r"<script\b[^>]*>(.*?)</script>", g.text, re.S | re.I):
        parse_script(g, m.group(1), m.start(1))
    name = g.path.split("/")[-1].rsplit(".", 1)[0]
    g.node("class", name, 1, len(g.lines), isSFC=True, framework=g.path.rsplit(".", 1)[-1])
