"""Python 3."""

from __future__ import annotations

import re

from .base import Bad, Cursor, Error, remember

# The language's keywords.
HARD = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
SOFT = ["match", "case", "type"]

LITERALS = re.compile(
    r"""(?P<comment>\#[^\n]*)|(?P<prefix>\b(?:[rR][bB]|[bB][rR]|[fF][rR]|[rR][fF]|[rRbBuUfF]))?(?P<quote>\"{3}|'{3})|(?P<p1>\b(?:[rR][bB]|[bB][rR]|[fF][rR]|[rR][fF]|[rRbBuUfF]))?(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<bad>["'])""",
    re.X,
)
TRIPLE = {'"""': re.compile(r'(?:[^"\\]|\\[\s\S]|"(?!""))*"""'), "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''")}
NUMBER = re.compile(r"(?<![\w.])(?:0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][+-]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*|[1-9](?:_?\d)*)(?!\w)")
NAME = re.compile(r"(?<!\w)(?!(?:" + "|".join(HARD + SOFT) + r")\b)[^\W\d]\w*")
TOKEN = re.compile(r"\s*(\*\*=|//=|>>=|<<=|\.\.\.|->|:=|[+\-*/%@&|^<>=!]=|\*\*|//|<<|>>|[A-Za-z]+|[()\[\]{},:;.=+\-*/%@&|^~<>\"0]|\S+?)")
FIELD = re.compile(r"[\w.]+\Z")

BINARY = {"or": 1, "and": 2, "in": 4, "not": 4, "is": 4, "<": 4, ">": 4, "==": 4, "!=": 4, "<=": 4, ">=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
AUGMENTED = {"+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="}
NAMES = {"n", "match", "case", "type"}
OPENERS = {"if": ("elif", "else"), "elif": ("elif", "else"), "for": ("else",), "while": ("else",), "try": ("except", "finally"), "except": ("except", "else", "finally"), "tryelse": ("finally",)}

_lines: dict[str, tuple] = {}
_fields: dict[str, bool] = {}


class Parser(Cursor):
    # Expressions return what they may be assigned to: "name", "ref", "seq" (a list of targets), "star", "" (nothing).
    def named(self) -> str:
        if self.peek() in NAMES and self.ahead() == ":=":
            self.i += 2
            self.test()
            return ""
        return self.test()

    def test(self) -> str:
        if self.take("lambda"):
            self.parameters(":", False)
            self.need(":")
            self.test()
            return ""
        kind = self.binary(1)
        if self.take("if"):
            self.binary(1)
            self.need("else")
            self.test()
            return ""
        return kind

    def binary(self, level: int) -> str:
        """Precedence climbing."""
        if level <= 3 and self.take("not"):
            self.binary(3)
            kind = ""
        else:
            kind = self.unary()
        while (p := BINARY.get(op := self.peek(), 0)) >= level:
            self.i += 1
            if op == "not":
                self.need("in")
            elif op == "is":
                self.take("not")
            if p == 1 or p == 2:
                self.binary(p + 1)
            else:
                self.binary(p + 1) if p > 4 else self.binary(5)
            kind = ""
        return kind

    def unary(self) -> str:
        if self.peek() in ("+", "-", "~"):
            self.i += 1
            self.unary()
            return ""
        waited = self.take("await")
        kind = self.primary()
        if self.take("**"):
            self.unary()
            return ""
        return "" if waited else kind

    def primary(self) -> str:
        kind = self.atom()
        while True:
            tok = self.peek()
            if tok == ".":
                self.i += 1
                if self.peek() not in NAMES:
                    self.fail("name expected after '.'")
                self.i += 1
                kind = "ref"
            elif tok == "(":
                self.i += 1
                self.arguments()
                kind = "call"
            elif tok == "[":
                self.i += 1
                self.subscript()
                kind = "ref"
            else:
                return "" if kind == "call" else kind

    def atom(self) -> str:
        tok = self.peek()
        self.i += 1
        if tok in NAMES:
            return "name"
        if tok == '"':
            while self.take('"'):
                pass
            return ""
        if tok in ("0", "...", "None", "True", "False"):
            return ""
        if tok == "(":
            if self.take(")"):
                return "seq"
            if self.peek() == "yield":
                self.yielded()
                self.need(")")
                return ""
            kind, many = self.items(")")
            return kind if not many else ("seq" if kind == "seq" else "")
        if tok == "[":
            if self.take("]"):
                return "seq"
            kind, _ = self.items("]")
            return "seq" if kind in ("name", "ref", "seq", "star") else ""
        if tok == "{":
            self.braces()
            return ""
        self.i -= 1
        self.fail("expression expected")

    def items(self, close: str) -> tuple[str, bool]:
        """Elements up to the closing bracket, or a comprehension."""
        first = self.element()
        if self.peek() in ("for", "async"):
            if first == "star":
                self.fail("unpacking in a comprehension")
            self.comprehension()
            self.need(close)
            return "", close == ")"
        kinds, many = [first], False
        while self.take(","):
            many = True
            if self.peek() == close:
                break
            kinds.append(self.element())
        self.need(close)
        if not many:
            if first == "star" and close == ")":
                self.fail("cannot use starred expression here")
            return first, False
        return ("seq" if all(k in ("name", "ref", "seq", "star") for k in kinds) else ""), True

    def element(self) -> str:
        if self.take("*"):
            return "star" if self.binary(5) else "starred"
        return self.named()

    def comprehension(self) -> None:
        while self.peek() in ("for", "async"):
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.binary(1)
            while self.take("if"):
                if self.peek() == "lambda":
                    self.test()
                elif self.peek() in NAMES and self.ahead() == ":=":
                    self.named()
                else:
                    self.binary(1)

    def braces(self) -> None:
        if self.take("}"):
            return
        if self.take("**"):
            self.binary(5)
            mapping = True
        else:
            self.element()
            mapping = self.take(":")
            if mapping:
                self.test()
            if self.peek() in ("for", "async"):
                self.comprehension()
                self.need("}")
                return
        while self.take(","):
            if self.peek() == "}":
                break
            if mapping:
                if self.take("**"):
                    self.binary(5)
                else:
                    self.test()
                    self.need(":")
                    self.test()
            else:
                self.element()
        self.need("}")

    def arguments(self) -> None:
        keyword = unpacked = False
        count = 0
        while not self.take(")"):
            count += 1
            if self.take("**"):
                self.test()
                unpacked = True
            elif self.take("*"):
                self.test()
                if unpacked:
                    self.fail("iterable argument unpacking follows keyword argument unpacking")
            elif self.peek() in NAMES and self.ahead() == "=":
                self.i += 2
                self.test()
                keyword = True
            else:
                self.named()
                if self.peek() in ("for", "async"):
                    self.comprehension()
                    if count > 1 or self.peek() != ")":
                        self.fail("generator expression must be parenthesized")
                elif keyword or unpacked:
                    self.fail("positional argument follows keyword argument")
            if not self.take(","):
                self.need(")")
                return

    def subscript(self) -> None:
        while True:
            if self.take("*"):
                self.binary(5)
            else:
                if self.peek() != ":":
                    self.named()
                if self.take(":"):
                    if self.peek() not in (":", "]", ","):
                        self.test()
                    if self.take(":") and self.peek() not in ("]", ","):
                        self.test()
            if not self.take(","):
                break
            if self.peek() == "]":
                break
        self.need("]")

    def targets(self) -> None:
        while True:
            self.take("*")
            kind = self.binary(5)
            if kind not in ("name", "ref", "seq"):
                self.fail("cannot assign to expression")
            if not self.take(",") or self.peek() in ("in", "=", ""):
                return

    def parameters(self, close: str, typed: bool) -> None:
        default = star = slash = False
        while self.peek() != close:
            if self.take("/"):
                if slash or star:
                    self.fail("invalid parameter list")
                slash = True
            elif self.take("**"):
                if self.peek() not in NAMES:
                    self.fail("parameter name expected")
                self.i += 1
                if typed and self.take(":"):
                    self.test()
                self.take(",")
                if self.peek() != close:
                    self.fail("parameter after **")
                return
            elif self.take("*"):
                if star:
                    self.fail("* twice")
                star = True
                if self.peek() in NAMES:
                    self.i += 1
                    if typed and self.take(":"):
                        self.element()
                elif self.peek() != "," or self.ahead() == close:
                    self.fail("named parameters must follow *")
            else:
                if self.peek() not in NAMES:
                    self.fail("parameter name expected")
                self.i += 1
                if typed and self.take(":"):
                    self.test()
                if self.take("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default follows parameter with a default")
            if not self.take(","):
                return

    def yielded(self) -> None:
        self.need("yield")
        if self.take("from"):
            self.test()
        elif self.peek() not in (")", "", ";", "="):
            self.star_list()

    def star_list(self) -> str:
        kinds, many = [self.element()], False
        while self.take(","):
            many = True
            if self.peek() in ("", ";", "=", ")", ":") or self.peek() in AUGMENTED:
                break
            kinds.append(self.element())
        if not many:
            if kinds[0] in ("star", "starred"):
                return "lonestar"
            return kinds[0]
        return "seq" if all(k in ("name", "ref", "seq", "star") for k in kinds) else ""

    # Statements.
    def simple(self) -> None:
        tok = self.peek()
        if tok in ("pass", "break", "continue"):
            self.i += 1
        elif tok == "return":
            self.i += 1
            if self.peek() not in ("", ";"):
                self.value()
        elif tok == "raise":
            self.i += 1
            if self.peek() not in ("", ";"):
                self.test()
                if self.take("from"):
                    self.test()
        elif tok in ("global", "nonlocal"):
            self.i += 1
            self.name_list()
        elif tok == "del":
            self.i += 1
            self.targets_del()
        elif tok == "assert":
            self.i += 1
            self.test()
            if self.take(","):
                self.test()
        elif tok == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.take("as"):
                    self.name()
                if not self.take(","):
                    break
        elif tok == "from":
            self.imported()
        elif tok == "type" and self.ahead() in NAMES:
            self.i += 2
            if self.take("["):
                self.subscript()
            self.need("=")
            self.test()
        else:
            self.assignment()

    def value(self) -> None:
        if self.peek() == "yield":
            self.yielded()
        elif self.star_list() == "lonestar":
            self.fail("cannot use starred expression here")

    def assignment(self) -> None:
        if self.peek() == "yield":
            self.yielded()
            return
        if self.ahead() == ":=":
            self.fail("assignment expression must be parenthesized here")
        kind = self.star_list()
        tok = self.peek()
        if tok == ":":
            if kind not in ("name", "ref"):
                self.fail("only single target can be annotated")
            self.i += 1
            self.test()
            if self.take("="):
                self.value()
            return
        if tok in AUGMENTED:
            if kind not in ("name", "ref"):
                self.fail("illegal expression for augmented assignment")
            self.i += 1
            self.value()
            return
        if kind == "lonestar":
            self.fail("cannot use starred expression here")
        while self.peek() == "=":
            if kind not in ("name", "ref", "seq"):
                self.fail("cannot assign to expression")
            self.i += 1
            if self.peek() == "yield":
                self.yielded()
                kind = ""
            else:
                kind = self.star_list()
                if kind == "lonestar":
                    self.fail("cannot use starred expression here")

    def name(self) -> None:
        if self.peek() not in NAMES:
            self.fail("name expected")
        self.i += 1

    def name_list(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def targets_del(self) -> None:
        while True:
            if self.binary(5) not in ("name", "ref", "seq"):
                self.fail("cannot delete expression")
            if not self.take(",") or self.peek() in ("", ";"):
                return

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def imported(self) -> None:
        self.need("from")
        dots = False
        while self.peek() in (".", "..."):
            self.i += 1
            dots = True
        if self.peek() != "import" or not dots:
            self.dotted()
        self.need("import")
        if self.take("*"):
            return
        bracket = self.take("(")
        while True:
            self.name()
            if self.take("as"):
                self.name()
            if not self.take(",") or bracket and self.peek() == ")":
                break
            if not bracket and not self.peek():
                self.fail("trailing comma not allowed without surrounding parentheses")
        if bracket:
            self.need(")")

    def statement(self) -> tuple[str, bool]:
        """Parses one logical line; (kind, a block must follow)."""
        tok = self.peek()
        if tok == "@":
            self.i += 1
            self.named()
            self.end()
            return "@", False
        kind = tok
        if tok == "async":
            self.i += 1
            tok = kind = self.peek()
            if tok not in ("def", "for", "with"):
                self.fail("invalid syntax after async")
        if tok in ("if", "elif", "while"):
            self.i += 1
            self.named()
        elif tok in ("else", "try", "finally"):
            self.i += 1
        elif tok == "for":
            self.i += 1
            self.targets()
            self.need("in")
            self.value()
        elif tok == "except":
            self.i += 1
            self.take("*")
            if self.peek() != ":":
                self.test()
                if self.take("as"):
                    self.name()
        elif tok == "with":
            self.i += 1
            self.with_items()
        elif tok == "def":
            self.i += 1
            self.name()
            if self.take("["):
                self.subscript()
            self.need("(")
            self.parameters(")", True)
            self.need(")")
            if self.take("->"):
                self.test()
        elif tok == "class":
            self.i += 1
            self.name()
            if self.take("["):
                self.subscript()
            if self.take("("):
                self.arguments()
        elif tok in ("match", "case") and self.t[-1] == ":" and self.ahead() not in ("=", ".", ",", "", ":", ")"):
            at = self.i
            try:
                self.i += 1
                if tok == "match":
                    self.star_list()
                else:
                    self.pattern()
                    if self.take("if"):
                        self.named()
                if self.peek() != ":":
                    raise Bad("", 0)
            except Bad:
                self.i = at
                self.run()
                return "simple", False
        else:
            self.run()
            return "simple", False
        self.need(":")
        if self.i < self.n:
            self.run()
            return kind, False
        return kind, True

    def pattern(self) -> None:
        """Patterns are read as expressions with stars, capture by 'as' and alternatives."""
        while True:
            self.take("*")
            self.binary(1)
            if self.take("as"):
                self.name()
            if not self.take(","):
                return
            if self.peek() in (":", "if"):
                return

    def with_items(self) -> None:
        at = self.i
        if self.take("("):  # either a parenthesised list of items or an expression
            try:
                while True:
                    self.test()
                    if self.take("as"):
                        self.targets_one()
                    if not self.take(",") or self.peek() == ")":
                        break
                self.need(")")
                if self.peek() == ":":
                    return
            except Bad:
                pass
            self.i = at
        while True:
            self.test()
            if self.take("as"):
                self.targets_one()
            if not self.take(","):
                return

    def targets_one(self) -> None:
        if self.binary(5) not in ("name", "ref", "seq"):
            self.fail("cannot assign to expression")

    def run(self) -> None:
        while True:
            self.simple()
            if not self.take(";") or self.i >= self.n:
                break
        self.end()

    def end(self) -> None:
        if self.i < self.n:
            self.fail("invalid syntax")


def _logical(shape: str) -> tuple:
    """(kind, block follows, error, net brackets) of a line's shape; a negative net closes what was not opened."""
    got = _lines.get(shape)
    if got is None:
        toks = TOKEN.findall(shape)
        net = sum(t in ("(", "[", "{") for t in toks) - sum(t in (")", "]", "}") for t in toks)
        kind, block, error = "simple", False, None
        if net <= 0:
            try:
                kind, block = Parser(toks).statement()
            except Bad as e:
                error = e.cause
                # Recovery: a broken header still opens its block.
                if toks and toks[-1] == ":" and toks[0] in ("if", "elif", "else", "for", "while", "try", "except", "finally", "with", "def", "class", "async"):
                    kind, block = toks[0], True
            except RecursionError:
                error = "nested too deeply"
        got = remember(_lines, shape, (kind, block, error, net))
    return got


def _field_ok(body: str) -> bool:
    """Whether the replacement fields of an f-string are valid expressions."""
    if "{" not in body and "}" not in body:
        return True
    s, i = body, 0
    while True:
        a, z = s.find("{", i), s.find("}", i)
        if a < 0 and z < 0:
            return True
        if z >= 0 and (a < 0 or z < a):  # only doubled outside of a field
            if s[z + 1 : z + 2] != "}":
                return False
            i = z + 2
            continue
        if s[a + 1 : a + 2] == "{":
            i = a + 2
            continue
        depth, j = 1, a + 1
        while j < len(s) and depth:
            depth += (s[j] in "{[(") - (s[j] in "}])")
            j += 1
        if depth:
            return False
        inner = s[a + 1 : j - 1]
        expr = re.split(r"![rsa](?=[:}]|\Z)|:(?!=)|=(?=\s*(?:\Z|:|!))", inner, maxsplit=1)[0] if not FIELD.match(inner) else inner
        if not FIELD.match(inner):
            if "(" in inner or "[" in inner or "{" in inner or "lambda" in inner or '"' in inner or "'" in inner:
                expr = _head(inner)
            shape, bad = _shape(expr.strip())
            if bad or not _expression(shape):
                return False
        i = j


def _head(inner: str) -> str:
    depth, quote = 0, ""
    for k, c in enumerate(inner):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0 and (c == ":" or c == "!" and inner[k + 1 : k + 2] in ("r", "s", "a") and inner[k + 2 : k + 3] in ("", ":")):
            return inner[:k]
        elif depth == 0 and c == "=" and inner[k + 1 :].strip()[:1] in ("", ":", "!") and inner[k - 1] not in "=!<>":
            return inner[:k]
    return inner


def _expression(shape: str) -> bool:
    got = _fields.get(shape)
    if got is None:
        try:
            p = Parser(TOKEN.findall(shape.replace("\n", " ")))
            p.value()
            p.end()
            got = True
        except (Bad, RecursionError):
            got = False
        remember(_fields, shape, got)
    return got


def _shape(text: str) -> tuple[str, list[tuple[int, str]]]:
    """The shape (newlines inside strings as \x01) and errors of literals by position in the text."""
    bad: list[tuple[int, str]] = []
    out, at = [], 0
    search = LITERALS.search
    while m := search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m["comment"] is not None:
            continue
        if m["str"] is not None:
            lit = m["str"]
            if m["p1"] and m["p1"].lower() in ("f", "fr", "rf") and not _field_ok(lit[1:-1]):
                # Since 3.12 a field may hold the same quote: read on to the end of the field.
                end = _nested_end(text, m.start("str"))
                if end and _field_ok(re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "0", text[m.start("str") + 1 : end - 1])):
                    lit, at = text[m.start("str") : end], end
                else:
                    bad.append((m.start(), "invalid field in f-string"))
            out.append('"' + "\x01" * lit.count("\n"))
        elif m["quote"]:
            e = TRIPLE[m["quote"]].match(text, at)
            if not e:
                bad.append((m.start(), "unterminated triple-quoted string"))
                out.append('"' + "\x01" * text.count("\n", at))
                at = len(text)
                break
            if m["prefix"] and m["prefix"].lower() in ("f", "fr", "rf") and not _field_ok(text[at : e.end() - 3]):
                bad.append((m.start(), "invalid field in f-string"))
            out.append('"' + "\x01" * text.count("\n", at, e.end()))
            at = e.end()
        else:
            bad.append((m.start(), "unterminated string"))
            stop = text.find("\n", at)
            out.append('"')
            at = len(text) if stop < 0 else stop
    out.append(text[at:])
    s = "".join(out)
    return NAME.sub("n", NUMBER.sub("0", s)), bad


def _nested_end(text: str, start: int) -> int:
    quote, depth, i = text[start], 0, start + 1
    while i < len(text) and text[i] != "\n":
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
        elif c == quote and depth <= 0:
            return i + 1
        i += 1
    return 0


def _width(indent: str) -> tuple[int, int]:
    col = alt = 0
    for c in indent:
        if c == "\t":
            col, alt = (col // 8 + 1) * 8, alt + 1
        elif c == "\f":
            col = alt = 0
        else:
            col, alt = col + 1, alt + 1
    return col, alt


def check_python(text: str) -> list[Error]:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    errors: list[Error] = []
    if "\0" in text:
        errors.append(Error(text[: text.index("\0")].count("\n") + 1, "null byte"))
        text = text.replace("\0", " ")
    shape, bad = _shape(text)
    errors += [Error(text.count("\n", 0, at) + 1, cause) for at, cause in bad]
    if "\\\n" in shape:
        shape = shape.replace("\\\n", "\x01")
    stack: list[tuple[int, int]] = [(0, 0)]
    last: list[str] = [""]  # the kind of the last statement, by level
    awaiting = ""  # a header whose block must follow
    decorated = False
    line, depth, parts, first = 0, 0, [], 0
    for raw in shape.split("\n"):
        line += 1
        if "\x01" in raw:
            extra = raw.count("\x01")
            raw = raw.replace("\x01", " ")
        else:
            extra = 0
        body = raw.strip(" \t\f")
        if depth <= 0:
            if not body:
                line += extra
                continue
            indent, first, parts = raw[: len(raw) - len(raw.lstrip(" \t\f"))], line, [body]
        else:
            parts.append(body)
        depth += _logical(body)[3] if body else 0
        line += extra
        if depth > 0:
            continue
        kind, block, error, net = _logical(body if len(parts) == 1 else " ".join(parts))
        depth = 0
        if net < 0 and not error:
            error = "unmatched closing bracket"
        if error:
            errors.append(Error(first, error))
        col = _width(indent) if indent else (0, 0)
        top = stack[-1]
        if awaiting:
            if col[0] > top[0] and col[1] > top[1]:
                stack.append(col)
                last.append("")
            else:
                errors.append(Error(first, f"expected an indented block after {awaiting!r}"))
            awaiting = ""
        elif col[0] > top[0]:
            errors.append(Error(first, "unexpected indent"))
            stack.append(col)
            last.append("")
        if col != stack[-1]:
            if col[0] == stack[-1][0] or (col[0] < stack[-1][0]) != (col[1] < stack[-1][1]):
                errors.append(Error(first, "inconsistent use of tabs and spaces"))
            while len(stack) > 1 and stack[-1][0] > col[0]:
                stack.pop()
                if last.pop() == "try":
                    errors.append(Error(first, "expected 'except' or 'finally' block"))
            if stack[-1][0] != col[0]:
                errors.append(Error(first, "unindent does not match any outer indentation level"))
        before = last[-1]
        if kind in ("elif", "else", "except", "finally"):
            if kind not in OPENERS.get(before, ()):
                errors.append(Error(first, f"{kind!r} without its statement"))
        elif before == "try":
            errors.append(Error(first, "expected 'except' or 'finally' block"))
        if decorated and kind not in ("@", "def", "class"):
            errors.append(Error(first, "function or class expected after decorator"))
        decorated = kind == "@"
        last[-1] = "tryelse" if kind == "else" and before == "except" else kind
        awaiting = kind if block else ""
    if depth > 0:
        errors.append(Error(first, "bracket was never closed"))
    if awaiting:
        errors.append(Error(line, f"expected an indented block after {awaiting!r}"))
    if "try" in last:
        errors.append(Error(line, "expected 'except' or 'finally' block"))
    if decorated:
        errors.append(Error(line, "function or class expected after decorator"))
    return sorted(errors)
