"""Tokens of TypeScript and JavaScript: strings, templates, regular expressions, comments and JSX told apart."""

from __future__ import annotations

import re

#: Words before which a "/" begins a regular expression and a "<" an element, as after an operator.
BEFORE_OPERAND = set("return typeof case in of instanceof new delete void throw do else yield await default extends".split())
_SIGNS = r"=>|\.\.\.|\?\.(?!\d)|[=!]==?|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\+\+|--|\*\*=?|[+\-*/%&|^]=|<<=?|<=|."
_PUNCT = re.compile(_SIGNS, re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TEMPLATE_STOP = re.compile(r"[^`\\$]*(?:(?:\\.|\$(?!\{))[^`\\$]*)*(`|\$\{)", re.S)
_TAG = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/>{]))")
_PARAMETER = re.compile(r"\s+extends\b|\s*,")
#: A token, or space or comments before it. What only the tokens before can tell apart, or what has code within (a template, "/", an element), goes to the end of the text.
_WORDS = {
    jsx: re.compile(
        r"[ \t]*([A-Za-z_$][A-Za-z0-9_$]*(?:[^\x00-\x7F\s][A-Za-z0-9_$]*)*|[(\[{)\]};,:@~]|\s+|'[^'\\\n]*(?:\\.[^'\\\n]*)*'?|\"[^\"\\\n]*(?:\\.[^\"\\\n]*)*\"?"
        r"|(?:[0-9]|\.\d)[\w.]*|#?[^\x00-\x7F\s](?:[A-Za-z0-9_$]|[^\x00-\x7F\s])*|#[A-Za-z_$](?:[A-Za-z0-9_$]|[^\x00-\x7F\s])*"
        rf"|//[^\n]*|/\*.*?(?:\*/|\Z)|[`/{'<' if jsx else ''}].*|{_SIGNS})",
        re.S,
    )
    for jsx in (False, True)
}
#: Texts up to this length are cut at once.
NEAR = 1 << 16
_SPACE, _OPEN, _CLOSE, _DOT, _HASH, _SLASH, _TEMPLATE, _ELEMENT = "space open close . # / ` <".split()
#: What only begins like a token of its own.
_SPECIAL = {_SLASH, _TEMPLATE, _ELEMENT}


class _Firsts(dict):
    """What a token is by its first character."""

    def __missing__(self, c: str) -> str:
        self[c] = found = _SPACE if c.isspace() else "name" if c >= "\x80" or c.isalpha() or c in "_$" else "number" if c.isdigit() else "punct"
        return found


_FIRST = _Firsts({"(": _OPEN, "[": _OPEN, "{": _OPEN, ")": _CLOSE, "]": _CLOSE, "}": _CLOSE, "'": "string", '"': "string", ".": _DOT, "#": _HASH, "/": _SLASH, "`": _TEMPLATE})
_FIRSTS = {False: _FIRST, True: _Firsts({**_FIRST, "<": _ELEMENT})}


class Lexer:
    """The tokens of a text, as columns: ``kinds`` (name, number, string, regex, punct), ``texts``, ``fresh`` (tokens with a line break before them), ``pair`` (brackets and those that close them), ``starts`` and ``numbers`` (tokens from which on the line, from 0, is another).
    The code parts of a template or an element stand between brackets, as an array of them would. ``ats``, where tokens begin, are complete only if ``near`` is 0."""

    def __init__(self, text: str, jsx: bool, near: int = NEAR):
        self.text, self.jsx, self.near = text, jsx, near
        self.kinds: list[str] = []
        self.texts: list[str] = []
        self.starts: list[int] = []
        self.numbers: list[int] = []
        self.ats: list[int] = []
        self.fresh: set[int] = set()
        self.pair: dict[int, int] = {}
        self.opened: list[int] = []
        self.counted, self.line = 0, 0  # lines are counted up to a place
        self.code((text.find("\n") if "\n" in text else len(text)) if text.startswith("#!") else 0, None)

    def put(self, kind: str, text: str, at: int, newline: bool = False) -> None:
        k = len(self.kinds)
        if newline:
            self.fresh.add(k)
        if kind == "punct":
            if text in "([{":
                self.opened.append(k)
            elif text in ")]}" and self.opened:
                self.pair[self.opened.pop()] = k
        self.line += self.text.count("\n", self.counted, at)
        self.counted = at
        if not k or self.numbers[-1] != self.line:
            self.starts.append(k)
            self.numbers.append(self.line)
        self.kinds.append(kind)
        self.texts.append(text)
        self.ats.append(at)

    def operand_next(self) -> bool:
        """Whether an operand is due after the tokens so far."""
        if not self.kinds:
            return True
        kind, last = self.kinds[-1], self.texts[-1]
        if kind == "name":
            return last in BEFORE_OPERAND and not (len(self.texts) > 1 and self.texts[-2] in (".", "?."))
        return kind == "punct" and last not in (")", "]", "++", "--")

    def code(self, i: int, stop: str | None) -> int:
        """Tokens from ``i`` to the unmatched ``stop``; the place after it."""
        text, n, depth, newline, words, firsts = self.text, len(self.text), 0, True, _WORDS[self.jsx], _FIRSTS[self.jsx]
        while i < n:
            if not stop and n - i <= self.near:
                i, newline = self.plain(i, newline)
                continue
            m = words.match(text, i)
            word = m[1]
            at, first = m.end() - len(word), firsts[word[0]]
            if first is _SPACE or (first is _SLASH and word[1:2] in ("/", "*")):
                newline = newline or "\n" in word
                i = m.end()
                continue
            if first in _SPECIAL:
                i = self.special(word[0], at, newline)
            else:
                if stop and first in (_OPEN, _CLOSE):
                    if word == stop and not depth:
                        return at + 1
                    depth += 1 if word == "{" else -1 if word == "}" else 0
                self.put(self.kind(first, word), word, at, newline)
                i = m.end()
            newline = False
        return n

    def kind(self, first: str, word: str) -> str:
        """A token's kind by the character that it begins with and, where that leaves it open, the next."""
        if first == _DOT:
            return "number" if word[1:2].isdecimal() else "punct"
        if first == _HASH:
            return "name" if len(word) > 1 else "punct"
        return "punct" if first in (_OPEN, _CLOSE) else first

    def plain(self, i: int, newline: bool) -> tuple[int, bool]:
        """Tokens from ``i`` to the next special one, which is taken too: cut by one call. The place after them."""
        kinds, texts, fresh, opened, pair, firsts = self.kinds, self.texts, self.fresh, self.opened, self.pair, _FIRSTS[self.jsx]
        line, moved, name, punct = self.line + self.text.count("\n", self.counted, i), True, "name", "punct"
        for word in _WORDS[self.jsx].findall(self.text, i):
            kind = firsts[word[0]]
            if kind is name or kind is punct:
                pass
            elif kind is _OPEN:
                opened.append(len(kinds))
                kind = punct
            elif kind is _CLOSE:
                if opened:
                    pair[opened.pop()] = len(kinds)
                kind = punct
            elif kind is _SPACE or (kind is _SLASH and word[1:2] in ("/", "*")):
                if "\n" in word:
                    newline = moved = True
                    line += word.count("\n")
                continue
            elif kind in _SPECIAL:
                at = len(self.text) - len(word)
                self.counted, self.line = at, line
                return self.special(word[0], at, newline), False
            else:
                kind = self.kind(kind, word)
            if moved:
                moved = False
                if not self.numbers or self.numbers[-1] != line:
                    self.starts.append(len(kinds))
                    self.numbers.append(line)
                if newline:
                    fresh.add(len(kinds))
                    newline = False
            kinds.append(kind)
            texts.append(word)
            if kind == "string" and "\n" in word:
                moved = True
                line += word.count("\n")
        return len(self.text), newline

    def special(self, c: str, i: int, newline: bool) -> int:
        """A template, a regular expression, an element, or what only begins like one."""
        if c == "`":
            return self.template(i, newline)
        text = self.text
        if c == "/" and self.operand_next() and (m := _REGEX.match(text, i)):
            self.put("regex", m.group(), i, newline)
            return m.end()
        if c == "<" and self.operand_next() and (m := _TAG.match(text, i)) and not _PARAMETER.match(text[m.end() : m.end() + 20]):
            self.put("punct", "[", i, newline)
            i = self.element(i)
            self.put("punct", "]", i - 1)
            return i
        m = _PUNCT.match(text, i)
        self.put("punct", m.group(), i, newline)
        return m.end()

    def template(self, i: int, newline: bool) -> int:
        start, text, n, opened = i, self.text, len(self.text), False
        i += 1
        while m := _TEMPLATE_STOP.match(text, i):
            i = m.start(1)
            if m.group(1) == "`":
                break
            self.put("punct", "," if opened else "[", i, newline and not opened)
            opened = True
            i = self.code(i + 2, "}")
        else:
            i = n
        end = min(i + 1, n)
        if opened:
            self.put("punct", "]", end - 1)
        else:
            self.put("string", text[start:end], start, newline)
        return end

    def element(self, i: int) -> int:
        """The code in an element that begins at ``i``: attributes and children in braces, elements within."""
        text, n, depth = self.text, len(self.text), 0
        while i < n:
            closing = text.startswith("</", i)
            m = _TAG.match(text, i)
            i = text.find(">", i) + 1 or n if closing else m.end() if m else i + 1
            closed = bool(m) and m.group() == "<>"
            while m and not closed and not closing and i < n:  # attributes
                c = text[i]
                if c in "'\"":
                    i = text.find(c, i + 1) + 1 or n
                elif c == "{":
                    i = self.code(i + 1, "}")
                    self.put("punct", ",", i - 1)
                elif c == ">":
                    closed, i = True, i + 1
                elif text.startswith("/>", i):
                    i += 2
                    break
                else:
                    i += 1
            depth += 1 if closed else -1 if closing else 0
            if depth <= 0:
                return i
            while i < n and not (text[i] == "<" and (text.startswith("</", i) or _TAG.match(text, i))):  # children
                if text[i] == "{":
                    i = self.code(i + 1, "}")
                    self.put("punct", ",", i - 1)
                else:
                    i += 1
        return n
