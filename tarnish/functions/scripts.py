"""What a script file imports, declares and refers to: one pass of a lexer with a stack of modes.

The lexer knows strings, nested templates, comments, regular expressions and
markup in code, so words inside them are no code. It builds no syntax tree:
scopes and types are not resolved, and a file that a parser would refuse is
read as far as it goes. Time is linear in the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

# Words of the language that name nothing, and those of them after which an expression begins.
KEYWORDS = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof let new null return "
    "super switch this throw true try typeof var void while with yield async of as from static get set undefined".split()
)
BEFORE_VALUE = frozenset("await case default delete do else extends in instanceof new return throw typeof void yield export of".split())
HEADED = frozenset(("if", "while", "for", "with", "switch"))
#: Lines of imports and exports that are listed of a file.
LINES = 40
FEED = re.compile("\n")
NAME = r"(?:[^\W\d]|\$)[\w$]*"
CODE = re.compile(
    rf"""(?P<space>\s+)|(?P<note>//[^\n]*|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)|\A\#![^\n]*)|(?P<name>{NAME})|(?P<private>\#{NAME})|(?P<number>\.?\d[\w.]*)
    |(?P<string>"(?:[^"\\\n]++|\\(?s:.))*+"?|'(?:[^'\\\n]++|\\(?s:.))*+'?)|(?P<punct>=>|\.\.\.|\?\.(?!\d)|\?\?=?|[=!]==?|[<>]=|&&=?|\|\|=?|\+\+|--|[-+*%&|^]=|(?s:.))""",
    re.VERBOSE,
)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/\w*")
CHUNK = re.compile(r"(?:[^`\\$]++|\\(?s:.)|\$(?!\{))*+")
KIDS = re.compile(r"[^<{]*")
TAG = re.compile(r"""\s+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)|"[^"]*"?|'[^']*'?|[^\W\d][\w$:.-]*|/>|(?s:.)""")
ELEMENT = re.compile(rf"<(?=\s*(?:{NAME}|>))(?!\s*{NAME}\s*(?:,|extends\b))")
TAG_NAME = re.compile(rf"\s*({NAME}(?:[.:-][\w$.:-]*)?)?")


class Token(NamedTuple):
    kind: str
    text: str
    at: int
    end: int
    fresh: bool  # begins a line
    operand: bool  # stands behind the end of an operand


def tokens(source: str, markup: bool = True) -> Iterator[Token]:
    """Tokens of code; templates, regular expressions and elements as one or a few each, without their text."""
    modes: list[str] = []
    ends: list[bool] = []  # of each open bracket: whether an operand ends where it closes
    at, value, fresh, last, divided = 0, False, True, "", 0

    def token(kind: str, text: str, start: int) -> Token:
        return Token(kind, text, start, at, fresh, value)

    while at < len(source):
        mode, start = modes[-1] if modes else "", at
        if mode == "template":
            at = CHUNK.match(source, at).end()
            if source.startswith("${", at):
                at += 2
                modes.append("{")
                ends.append(False)
                yield token("punct", "{", at - 1)
                value, last = False, "{"
            else:
                at += 1
                modes.pop()
                yield token("template", "", start)
                value, fresh, last = True, False, "`"
            continue
        if mode == "kids":
            at = KIDS.match(source, at).end()
            if source.startswith("{", at):
                at += 1
                modes.append("{")
                ends.append(False)
                yield token("punct", "{", at - 1)
                value, last = False, "{"
            elif at < len(source):
                closing = source.startswith("</", at)
                if closing:
                    modes[-1] = "close"
                else:
                    modes.append("tag")
                named = TAG_NAME.match(source, at + 1 + closing)
                at = named.end()
                yield token("markup", named[1] or "", start)
            continue
        if mode in ("tag", "close"):
            part = TAG.match(source, at)
            at = part.end()
            if part[0] == "{":
                modes.append("{")
                ends.append(False)
                yield token("punct", "{", start)
                value, last = False, "{"
            elif part[0] == "/>" or part[0] == ">" and mode == "close":
                modes.pop()
                yield token("element", "", start)
                value, fresh, last = True, False, ">"
            elif part[0] == ">":
                modes[-1] = "kids"
            continue
        part = CODE.match(source, at)
        kind, text, at = part.lastgroup, part[0], part.end()
        if kind in ("space", "note"):
            fresh = fresh or "\n" in text
            continue
        if text == "/" and not value and start >= divided:
            if literal := REGEX.match(source, start):
                kind, text, at = "regex", "", literal.end()
            else:  # no other literal is looked for on this line
                divided = source.find("\n", start) + 1 or len(source)
        elif text == "`":
            modes.append("template")
            continue
        elif text == "<" and markup and not value and (element := ELEMENT.match(source, start)):
            modes.append("tag")
            named = TAG_NAME.match(source, element.end())
            at = named.end()
            yield token("markup", named[1] or "", start)
            fresh = False
            continue
        yield token(kind, text, start)
        if kind == "punct" and text in "([{":
            modes.append(text)
            ends.append(last not in HEADED if text == "(" else text == "[" or bool(last) and last not in (")", ";", "{", "}", "=>", "else", "do", "try", "finally") and (not value or last == "`"))
            value = False
        elif kind == "punct" and text in ")]}":
            if modes and modes[-1] == {")": "(", "]": "[", "}": "{"}[text]:
                modes.pop()
                value = ends.pop()
            else:
                value = True
        elif kind == "name":
            value = last in (".", "?.") or text not in BEFORE_VALUE
        else:
            value = kind != "punct" or text in ("++", "--") and value
        fresh, last = False, text if kind in ("punct", "name") else kind


class Fact(NamedTuple):
    kind: str  # import, line, function, component, reference
    name: str | None
    line: int | None
    line_end: int | None
    exported: bool | None
    text: str | None


class Reader:
    """Facts of one file, from its tokens and the brackets that match."""

    def __init__(self, source: str, markup: bool):
        self.source, self.t = source, list(tokens(source, markup))
        self.lines = [0, *(m.end() for m in FEED.finditer(source))]
        self.close: dict[int, int] = {}
        self.depth: list[int] = []
        self.unread: set[int] = set()  # tokens that are no reference
        self.room = LINES
        open_: list[int] = []
        for k, x in enumerate(self.t):
            if x.kind == "punct" and x.text in ")]}" and open_:
                self.close[open_.pop()] = k
            self.depth.append(len(open_))
            if x.kind == "punct" and x.text in "([{":
                open_.append(k)
        self.open = {b: a for a, b in self.close.items()}

    def text(self, k: int) -> str:
        """Of a name or sign; other tokens have none."""
        return self.t[k].text if 0 <= k < len(self.t) and self.t[k].kind in ("name", "punct") else ""

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def listed(self, k: int) -> Iterator[Fact]:
        """The line an import or export begins on, of the first so many."""
        line = self.line(self.t[k].at)
        text = self.source[self.lines[line - 1] : self.lines[line] - 1 if line < len(self.lines) else None].strip()
        if text and self.room:
            self.room -= 1
            yield Fact("line", None, line, None, None, text)

    def string(self, k: int) -> str | None:
        return self.t[k].text[1:-1] if k < len(self.t) and self.t[k].kind == "string" else None

    def begins(self, k: int) -> bool:
        """Whether a statement begins here."""
        return k == 0 or self.text(k - 1) in (";", "}", "{", "export", "declare") or self.t[k].fresh and self.t[k].operand

    def facts(self) -> Iterator[Fact]:
        k = 0
        while k < len(self.t):
            word = self.t[k].text if self.t[k].kind == "name" and self.text(k - 1) not in (".", "?.") else ""
            if word in ("require", "import") and self.text(k + 1) == "(" and self.text(k - 1) not in ("new", "function"):
                if self.string(k + 2) is not None and self.text(k + 3) in (")", ",") and not self.assigned_import(k):
                    yield Fact("import", self.string(k + 2), self.line(self.t[k].at), None, None, None)
            elif word == "import" and self.text(k + 1) != "." and self.begins(k):
                end = self.import_end(k)
                if end:
                    yield Fact("import", self.string(end), self.line(self.t[k].at), None, None, None)
                    yield from self.listed(k)
                    self.unread.update(range(k, end))
                    k = end
            elif word == "export" and self.begins(k):
                yield from self.export(k)
            elif word == "function" and self.text(k - 1) not in ("default",):
                yield from self.function(k)
            elif word in ("const", "let", "var"):
                yield from self.variables(k)
            k += 1
        yield from self.references()

    def assigned_import(self, k: int) -> bool:
        return self.text(k - 1) == "=" and self.text(k - 3) in ("import", "type") and self.t[k - 2].kind == "name"

    def import_end(self, k: int) -> int | None:
        """Where the specifier of an import declaration stands."""
        k += 1
        while k < len(self.t):
            if self.string(k) is not None and self.text(k - 1) in ("import", "from"):
                return k
            if self.text(k) == "{" and k in self.close:
                k = self.close[k]
            elif not (self.t[k].kind == "name" or self.text(k) in ("*", ",")):
                return None
            k += 1
        return None

    def export(self, k: int) -> Iterator[Fact]:
        next_ = self.text(k + 1)
        if next_ in ("default", "=", "import", "as") or next_ == "*" and self.text(k + 2) != "as":
            return
        yield from self.listed(k)
        if next_ == "*":
            self.unread.add(k + 3)
        if next_ == "type" and self.text(k + 2) == "{":
            k += 1
        if self.text(k + 1) == "{" and (end := self.close.get(k + 1)):
            afar = self.text(end + 1) == "from"
            self.unread.update(x for x in range(k + 2, end) if afar or self.text(x - 1) == "as")

    def symbol(self, name: int, first: int, last: int, exported: bool) -> Fact:
        a, b = self.line(self.t[first].at), self.line(self.t[last].end - 1)
        end = self.lines[b] - 1 if b < len(self.lines) else len(self.source)
        word = self.t[name].text
        return Fact("component" if re.match("[A-Z]", word) else "function", word, a, b, exported, self.source[self.lines[a - 1] : end])

    def function(self, k: int) -> Iterator[Fact]:
        name = k + 1 + (self.text(k + 1) == "*")
        first = k - (self.text(k - 1) == "async" and not self.t[k].fresh)
        exported = self.text(first - 1) == "export"
        if name < len(self.t) and self.t[name].kind == "name" and self.begins(first) and (self.depth[k] == 0 or exported):
            body = self.body(k)
            if body is not None and body in self.close:
                yield self.symbol(name, first, self.close[body], exported)

    def body(self, k: int) -> int | None:
        """The bracket that opens a function's body, none of a mere signature."""
        while k < len(self.t) and self.text(k) != "(":
            k += 1
        k = self.close.get(k, len(self.t)) + 1
        if self.text(k) == ":":
            k += 1
            while k < len(self.t) and (self.text(k) != "{" or self.text(k - 1) in (":", "|", "&", "<", ",", "=>")):
                if self.text(k) in (";", "=") or self.text(k) == "" and self.t[k].fresh:
                    return None
                k = self.close.get(k, k) + 1
        return k if self.text(k) == "{" else None

    def variables(self, k: int) -> Iterator[Fact]:
        """Declarators of one statement, those whose value is a function as symbols."""
        exported = self.text(k - 1) == "export"
        counts = exported or self.depth[k] == 0 and self.begins(k)
        name = k + 1
        while name < len(self.t):
            if self.text(name) in ("{", "["):
                end = self.close.get(name, name)
                self.unread.update(x for x in range(name, end) if self.t[x].kind == "name" and self.text(x - 1) in ("{", "[", ",", "...", ":") and self.text(x + 1) in (",", "}", "]", ":", "="))
                return
            if self.t[name].kind != "name":
                return
            self.unread.add(name)
            at = self.past_type(name + 1)
            if self.text(at) != "=" or not counts:
                return
            end = self.function_value(at + 1)
            if end is None:
                return
            yield self.symbol(name, name, end, exported)
            if self.text(end + 1) != ",":
                return
            name = end + 2

    def past_type(self, k: int) -> int:
        k += self.text(k) == "!"
        if self.text(k) != ":":
            return k
        while k < len(self.t) and self.text(k) not in ("=", ";", ","):
            k = self.close.get(k, k) + 1
        return k

    def function_value(self, k: int) -> int | None:
        """The last token of a function or arrow function that begins here, none if the value is anything else."""
        wrapped = 0
        while self.text(k) == "(" and self.text(self.close.get(k, -1) + 1) not in ("=>", ":"):
            if self.close.get(k) is None or not self.ends(self.close[k]):
                return None
            k, wrapped = k + 1, wrapped + 1
        k += self.text(k) == "async" and self.text(k + 1) != "=>"
        if self.text(k) == "function":
            body = self.body(k)
            end = self.close.get(body) if body is not None else None
        else:
            end = self.arrow_end(k)
        for _ in range(wrapped if end is not None else 0):
            end = end + 1 if self.text(end + 1) == ")" else end
        return end if end is not None and self.ends(end) else None

    def arrow_end(self, k: int) -> int | None:
        if self.text(k) == "<":  # type parameters
            level = 0
            while k < len(self.t):
                level += {"<": 1, ">": -1}.get(self.text(k), 0)
                k += 1
                if level == 0:
                    break
        if self.text(k) == "(":
            k = self.close.get(k, len(self.t)) + 1
            if self.text(k) == ":":
                while k < len(self.t) and self.text(k) not in ("=>", ";"):
                    k = self.close.get(k, k) + 1
        elif k < len(self.t) and self.t[k].kind == "name":
            k += 1
        if self.text(k) != "=>":
            return None
        k += 1
        if self.text(k) == "{":
            return self.close.get(k)
        while k < len(self.t):
            k = self.close.get(k, k)
            if self.ends(k):
                return k
            k += 1
        return None

    def ends(self, k: int) -> bool:
        """Whether a declarator's value can end with this token."""
        if k + 1 >= len(self.t) or self.text(k + 1) in (";", ",", ")", "}"):
            return True
        after = self.t[k + 1]
        return after.fresh and (after.operand or self.text(k) == "}") and after.kind != "template" and not (after.kind == "punct" and after.text not in ("{", "@")) and after.text not in ("in", "instanceof", "as", "satisfies")

    def references(self) -> Iterator[Fact]:
        self.parameters()
        found = set()
        for k, x in enumerate(self.t):
            if x.kind == "markup" and re.fullmatch(r"[A-Z][\w$]*", x.text):
                found.add(x.text)
            if x.kind != "name" or x.text in KEYWORDS or k in self.unread:
                continue
            before, after = self.text(k - 1), self.text(k + 1)
            key = after == ":" and before in ("{", ",", "(", ";", "readonly") or after == "?" and self.text(k + 2) == ":" or after == ":" and self.begins(k)
            if before in (".", "?.", "function", "class") or self.text(k - 2) == "function" and before == "*" or after in ("=", "=>") or key:
                continue
            found.add(x.text)
        for name in sorted(found):
            yield Fact("reference", name, None, None, None, None)

    def parameters(self) -> None:
        """Bare names in the brackets before an arrow or a body are declared there, and a name before brackets and a body names a method."""
        for a, b in self.close.items():
            if self.text(a) != "(":
                continue
            head, after = self.text(a - 1), self.text(b + 1)
            if after == "=>" or after == "{" and head not in HEADED:
                self.unread.update(x for x in range(a + 1, b) if self.t[x].kind == "name" and self.text(x - 1) in ("(", ",", "{", "[", "...") and self.text(x + 1) in (",", ")", "}", "]"))
                if after == "{" and a and self.text(a - 2) in ("{", "}", ",", ";", "async", "get", "set", "static", "public", "private", "protected", "override", "*"):
                    self.unread.add(a - 1)


def facts(source: str | None, markup: bool | None = True) -> Iterator[Fact]:
    """Facts of a file; `markup` tells whether elements can stand in its code. Null has none."""
    return Reader(source, markup is not False).facts() if source else iter(())
