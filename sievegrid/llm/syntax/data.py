"""JSON (strict), TOML and YAML."""

from __future__ import annotations

import datetime
import re

from .base import Error

JSON_TOKEN = re.compile(r'[ \t\r\n]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true\b|false\b|null\b)|([\[\]{},:])|(\Z)|(\S))')


def check_json(text: str) -> list[Error]:
    """A stack machine over the tokens: recursion of arrays and objects without Python's own stack."""
    errors: list[Error] = []
    stack: list[str] = []
    want = "value"  # value, first (value or close), key, firstkey, colon, next, end
    panic, inner, at = False, 0, 0  # skipping behind an error, up to a comma or bracket outside of brackets opened meanwhile
    while m := JSON_TOKEN.search(text, at):
        kind, tok, at = m.lastindex, m[m.lastindex], m.end()
        if kind == 4:
            break
        if kind == 5 and tok == '"':
            at = max(at, JSON_BROKEN.match(text, m.start(5)).end())
        if panic:
            if kind != 3:
                continue
            if tok in "[{":
                if not stack and want == "value":
                    panic = False
                else:
                    inner += 1
                    continue
            elif tok in "]}" and inner:
                inner -= 1
                continue
            elif inner or tok == ":":
                continue
            else:
                panic, want = _resume(stack, tok, want)
                continue
        bad = kind == 5
        if kind in (1, 2):
            if want in ("value", "first"):
                want = "next" if stack else "end"
            elif want in ("key", "firstkey") and kind == 1:
                want = "colon"
            else:
                bad = True
        elif kind == 3:
            if tok in "[{" and want in ("value", "first"):
                stack.append(tok)
                want = "first" if tok == "[" else "firstkey"
            elif tok in "]}" and stack and stack[-1] == ("[" if tok == "]" else "{") and want in ("next", "first" if tok == "]" else "firstkey"):
                stack.pop()
                want = "next" if stack else "end"
            elif tok == "," and want == "next":
                want = "value" if stack[-1] == "[" else "key"
            elif tok == ":" and want == "colon":
                want = "value"
            else:
                bad = True
        if bad:
            errors.append(Error(text.count("\n", 0, m.start(m.lastindex)) + 1, f"unexpected {tok[:20]!r}, {want} expected"))
            panic, inner = True, 0
            if kind == 3 and tok in "[{":
                inner = 1
            elif kind == 3 and tok != ":":
                panic, want = _resume(stack, tok, want)
    if want != "end" and (stack or not errors):
        errors.append(Error(text.count("\n") + 1, "unexpected end"))
    return errors


#: A string that is none: up to its closing quote or the end of its line.
JSON_BROKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"?')


def _resume(stack: list[str], tok: str, want: str) -> tuple[bool, str]:
    """(panic, want) at a comma or closing bracket behind an error."""
    if tok == ",":
        return (False, "value" if stack[-1] == "[" else "key") if stack else (True, want)
    opener = "[" if tok == "]" else "{"
    if opener in stack:
        while stack.pop() != opener:
            pass
        return False, "next" if stack else "end"
    return True, want


KEY = r"(?:[A-Za-z0-9_-]+|\"(?:[^\"\\\n]|\\.)*\"|'[^'\n]*')"
TOML_KEY = re.compile(rf"[ \t]*({KEY}(?:[ \t]*\.[ \t]*{KEY})*)[ \t]*")
TOML_PART = re.compile(KEY)
TOML_VALUE = re.compile(
    r"""(?P<ml>\"\"\"(?:[^\\"]|\\[\s\S]|"(?!""))*\"{3,5}|'''(?:[^']|'(?!''))*'{3,5})|(?P<str>"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:[btnfre"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{2}))*"|'[^'\x00-\x08\x0a-\x1f\x7f]*')"""
    r"""|(?P<date>\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})?)?|\d{2}:\d{2}:\d{2}(?:\.\d+)?)|(?P<num>0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|[+-]?(?:inf|nan))(?![\w.])|(?P<bool>(?:true|false)\b)|(?P<open>[\[{])""",
)
BLANK = re.compile(r"(?:[ \t\r\n]|#[^\n]*)*")
REST = re.compile(r"[ \t]*(?:#[^\n]*)?(?:\r?\n|\Z)")


class _Toml:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def fail(self, cause: str):
        raise ValueError(cause)

    def value(self) -> object:
        m = TOML_VALUE.match(self.s, self.i)
        if not m:
            self.fail("invalid value")
        self.i = m.end()
        if m["date"]:
            try:
                d = m["date"]
                datetime.date.fromisoformat(d[:10]) if "-" in d[:10] else datetime.time.fromisoformat(d[:8])
            except ValueError:
                self.fail("invalid date")
        if not m["open"]:
            return None
        if m["open"] == "[":
            while True:
                self.i = BLANK.match(self.s, self.i).end()
                if self.s[self.i : self.i + 1] == "]":
                    break
                self.value()
                self.i = BLANK.match(self.s, self.i).end()
                c = self.s[self.i : self.i + 1]
                if c == ",":
                    self.i += 1
                elif c != "]":
                    self.fail("unclosed array")
            self.i += 1
            return None
        table: dict = {}
        sep = False
        while True:
            self.i = re.compile(r"[ \t]*").match(self.s, self.i).end()
            if self.s[self.i : self.i + 1] == "}":
                if sep:
                    self.fail("trailing comma in inline table")
                self.i += 1
                return table
            if table and not sep:
                self.fail("expected ',' or '}' in inline table")
            self.pair(table)
            self.i = re.compile(r"[ \t]*").match(self.s, self.i).end()
            sep = self.s[self.i : self.i + 1] == ","
            self.i += sep

    def pair(self, table: dict) -> None:
        m = TOML_KEY.match(self.s, self.i)
        if not m:
            self.fail("invalid statement")
        if self.s[m.end() : m.end() + 1] != "=":
            self.i = m.end()
            self.fail("expected '=' after a key")
        self.i = m.end() + 1
        while self.s[self.i : self.i + 1] in (" ", "\t"):
            self.i += 1
        value = self.value()
        parts = _parts(m[1])
        for p in parts[:-1]:
            table = table.setdefault(p, {})
            if not isinstance(table, dict) or "\0closed" in table:
                self.fail("key is no table")
        if parts[-1] in table:
            self.fail("key given twice")
        if isinstance(value, dict):
            value["\0closed"] = 1
        table[parts[-1]] = value


def _parts(key: str) -> list[str]:
    return [p.strip("\"'") if p[0] in "\"'" else p for p in TOML_PART.findall(key)]


def check_toml(text: str) -> list[Error]:
    errors: list[Error] = []
    p = _Toml(text)
    root: dict = {}
    table = root
    heads: set[tuple] = set()
    while p.i < len(text):
        p.i = BLANK.match(text, p.i).end()
        if p.i >= len(text):
            break
        start = p.i
        try:
            if text[p.i] == "[":
                many = text.startswith("[[", p.i)
                m = TOML_KEY.match(text, p.i + 1 + many)
                if not m or not text.startswith("]" * (1 + many), m.end()):
                    p.fail("expected ']' at the end of a table declaration")
                p.i = m.end() + 1 + many
                parts = _parts(m[1])
                table = root
                for k, q in enumerate(parts):
                    leaf = k == len(parts) - 1
                    nxt = table.get(q)
                    if leaf and many:
                        if nxt is None:
                            nxt = table[q] = []
                        if not isinstance(nxt, list):
                            p.fail("table given twice")
                        nxt.append({})
                        table = nxt[-1]
                        continue
                    if nxt is None and q not in table:
                        nxt = table[q] = {}
                    if isinstance(nxt, list):
                        if leaf:
                            p.fail("table given twice")
                        nxt = nxt[-1]
                    if not isinstance(nxt, dict) or "\0closed" in nxt:
                        p.fail("key is no table")
                    table = nxt
                if not many:
                    ident = id(table)
                    if ident in heads:
                        p.fail("table given twice")
                    heads.add(ident)
            else:
                p.pair(table)
            m = REST.match(text, p.i)
            if not m:
                p.fail("expected newline or end of document after a statement")
            p.i = m.end()
        except (ValueError, RecursionError) as e:
            errors.append(Error(text.count("\n", 0, max(start, min(p.i, len(text)))) + 1, str(e)[:80]))
            stop = text.find("\n", p.i)
            p.i = len(text) if stop < 0 else stop + 1
    return errors


# YAML: block structure by indentation; flow collections and quoted scalars by a small scanner.
Y_KEY = re.compile(r"""(?:\?[ \t]+)?(?:[&!][^\s,\[\]{}]+[ \t]+)*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`][^#\n]*?|[\-?:](?=[^\s,\[\]{}])[^#\n]*?|\*[^\s,\[\]{}]+ |<<|[^\s\-?:,\[\]{}&*!|>'"%@`](?:[^\n:#]|:(?=\S)|(?<=\S)\#)*?)[ \t]*:(?=[ \t]|$)""")
Y_PROPS = re.compile(r"(?:(?:&[^\s,\[\]{}]+|![^\s,\[\]{}]*)(?:[ \t]+|$))+")
Y_BLOCK = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-]?)[ \t]*(?:#.*)?$")
Y_DQ = re.compile(r'"(?:[^"\\]|\\(?:[0abtnvfre "/\\N_LP\t\n]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
Y_SQ = re.compile(r"'(?:[^']|'')*'")
Y_END = re.compile(r"[ \t]*(?:(?<=[ \t])#.*|$)|[ \t]+#.*$")


class _Yaml:
    def __init__(self, text: str):
        self.errors: list[Error] = []
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.i = 0
        self.anchors: set[str] = set()

    def fail(self, cause: str, line: int | None = None):
        raise _YamlBad(cause, (self.i if line is None else line) + 1)

    def skip(self) -> tuple[int, str] | None:
        """Indent and content of the next line with content."""
        while self.i < len(self.lines):
            raw = self.lines[self.i]
            body = raw.lstrip(" ")
            if not body or body[0] == "#" or not body.strip():
                self.i += 1
                continue
            if body[0] == "\t" and body.strip() and body.strip()[0] != "#":
                self.fail("tab in indentation")
            if raw.startswith(("---", "...")) and (len(raw) == 3 or raw[3] in " \t"):
                return -1, raw
            return len(raw) - len(body), body
        return None

    def recover(self, bad: _YamlBad, indent: int, start: int) -> None:
        """Moves behind an error to the next line of this indentation or less, or the next document."""
        self.errors.append(Error(bad.line, bad.cause))
        self.i = max(start + 1, bad.line)
        while self.i < len(self.lines):
            raw = self.lines[self.i]
            body = raw.strip(" \t")
            if body and body[0] != "#" and raw[len(raw) - len(raw.lstrip(" "))] != "\t" and len(raw) - len(raw.lstrip(" ")) <= indent:
                return
            self.i += 1

    def document(self) -> None:
        first = head = True
        while True:
            start, indent = self.i, 0
            try:
                at = self.skip()
                if not at:
                    return
                if head and at[1].startswith("%") and at[0] == 0:
                    self.i += 1
                    continue
                head = False
                indent = max(0, at[0])
                if at[0] == -1:
                    rest = at[1][3:].strip()
                    first = True
                    if at[1].startswith("..."):
                        if rest and rest[0] != "#":
                            self.fail("text after document end")
                        self.i += 1
                        continue
                    self.anchors = set()
                    if rest and rest[0] != "#":
                        self.lines[self.i] = "   " + at[1][3:]
                        self.node(3, self.skip(), -1)
                        first = False
                        continue
                    self.i += 1
                    continue
                if not first:
                    self.fail("text after the document's node")
                self.node(at[0], at, -1)
                first = False
            except _YamlBad as e:
                first = True
                self.recover(e, indent, start)

    def node(self, indent: int, at: tuple[int, str], parent: int) -> None:
        """A block node whose first line is the current one."""
        body = at[1]
        if (body[0] == "-" and (len(body) == 1 or body[1] in " \t")):
            self.sequence(indent)
        elif body[0] == "?" and (len(body) == 1 or body[1] in " \t"):
            self.i += 1  # complex keys: accepted as they stand
            while (nxt := self.skip()) and nxt[0] > indent:
                self.i += 1
        elif self.key(body):
            self.mapping(indent)
        else:
            self.scalar(body, indent, parent, self.i)

    def key(self, body: str) -> re.Match | None:
        if body[0] in "\"'":
            m = (Y_DQ if body[0] == '"' else Y_SQ).match(body)
            if m and re.match(r"[ \t]*:(?=[ \t]|$)", body[m.end() :]):
                return re.compile(re.escape(m[0]) + r"[ \t]*:(?=[ \t]|$)").match(body)
            return None
        if body[0] in "[{":
            return None
        return _plain_key(body)

    def sequence(self, indent: int) -> None:
        self.block(indent, self.item)

    def block(self, indent: int, part) -> None:
        """Parts of one indentation, until `part` says that there is none; a bad one is left behind."""
        while True:
            start = self.i
            try:
                at = self.skip()
                if not at or at[0] != indent or not part(indent, at):
                    self.closed(indent, at)
                    return
            except _YamlBad as e:
                self.recover(e, indent, start)

    def item(self, indent: int, at: tuple[int, str]) -> bool:
        if at[1][0] == "-" and (len(at[1]) == 1 or at[1][1] in " \t"):
            rest = at[1][1:]
            inner = rest.lstrip(" \t")
            if not inner or inner[0] == "#":
                self.i += 1
                nxt = self.skip()
                if nxt and nxt[0] > indent:
                    self.node(nxt[0], nxt, indent)
                return True
            if "\t" in rest[: len(rest) - len(inner)] and (inner[0] == "-" or self.key(inner)):
                self.fail("tab in indentation")
            deeper = indent + 1 + len(rest) - len(inner)
            self.lines[self.i] = " " * deeper + inner
            self.entry(deeper, inner, indent)
            return True
        return False

    def entry(self, indent: int, body: str, parent: int) -> None:
        p = Y_PROPS.match(body)
        if p and not _plain_key(body):
            rest = body[p.end() :]
            if not rest.strip() or rest.lstrip()[0] == "#":
                self.i += 1
                nxt = self.skip()
                if nxt and nxt[0] > parent:
                    self.node(nxt[0], nxt, parent)
                return
        self.node(indent, (indent, body), parent)

    def mapping(self, indent: int) -> None:
        self.block(indent, self.pair)

    def pair(self, indent: int, at: tuple[int, str]) -> bool:
        # Repeated keys are left to the loader.
        body = at[1]
        m = self.key(body)
        if not m:
            if body[0] == "-" and (len(body) == 1 or body[1] in " \t"):
                self.fail("sequence entry where a key is expected")
            self.fail("key expected")
        rest = body[m.end() :].strip(" \t")
        p = Y_PROPS.match(rest)
        if p:
            rest = rest[p.end() :]
        if not rest or rest[0] == "#":
            self.i += 1
            nxt = self.skip()
            if nxt and (nxt[0] > indent or nxt[0] == indent and nxt[1][0] == "-" and (len(nxt[1]) == 1 or nxt[1][1] in " \t")):
                self.node(nxt[0], nxt, indent)
            return True
        if rest[0] == "-" and (len(rest) == 1 or rest[1] in " \t"):
            self.fail("block sequence entries are not allowed here")
        self.scalar(rest, indent + 1, indent, self.i)
        return True

    def closed(self, indent: int, at: tuple[int, str] | None) -> None:
        if at and at[0] > indent:
            self.fail("bad indentation")

    def scalar(self, rest: str, indent: int, parent: int, line: int) -> None:
        """A scalar or flow node that starts with `rest` on the current line."""
        c = rest[0]
        p = Y_PROPS.match(rest)
        if p:
            rest = rest[p.end() :]
            if not rest:
                self.i += 1
                return
            c = rest[0]
        if c in "|>":
            if not Y_BLOCK.match(rest):
                self.fail("invalid block scalar header")
            self.i += 1
            while self.i < len(self.lines):
                raw = self.lines[self.i]
                body = raw.strip(" ")
                if body and len(raw) - len(raw.lstrip(" ")) <= parent:
                    break
                self.i += 1
            return
        if c in "\"'[{":
            end = self.flow(rest, parent, line)
            if end is not None and not Y_END.fullmatch(end) and not (end.lstrip(" \t")[:1] == "#" and end[:1] in " \t"):
                self.fail("unexpected text after a value" if end.lstrip()[:1] != ":" else "mapping values are not allowed here")
            self.i += 1
            return
        if c in "%@`":
            self.fail(f"{c!r} cannot start a value")
        if c in ",]}":
            self.fail(f"unexpected {c!r}")
        if c in "-?:" and (len(rest) == 1 or rest[1] in " \t"):
            self.fail("mapping values are not allowed here")
        if c == "*" and not re.match(r"\*[^\s,\[\]{}]+[ \t]*(?:#.*)?$", rest):
            self.fail("unexpected text after an alias")
        self.plain(rest)
        comment = " #" in rest
        self.i += 1
        while nxt := self.skip():
            if nxt[0] <= parent:
                return
            if comment:
                self.fail("bad indentation")
            if nxt[1][0] == "#":
                return
            self.plain(nxt[1])
            self.i += 1

    def plain(self, text: str) -> None:
        text = re.split(r"[ \t]#", text, maxsplit=1)[0]
        if re.search(r":(?:[ \t]|$)", text):
            self.fail("mapping values are not allowed here")

    def flow(self, rest: str, parent: int, line: int) -> str | None:
        """Reads a quoted scalar or flow collection over as many lines as it takes; what follows it on its last line."""
        stack: list[str] = []
        expect = True  # an entry or value may start
        s = rest
        while True:
            s = s.lstrip(" \t")
            while not s or s[0] == "#":
                self.i += 1
                if self.i >= len(self.lines):
                    self.fail("unclosed flow collection or quoted value", line)
                s = self.lines[self.i]
                if s.strip() and len(s) - len(s.lstrip(" ")) <= parent and parent >= 0 and s.strip() not in ("]", "}", "],", "},"):
                    self.fail("unclosed flow collection", line)
                s = s.lstrip(" \t")
            c = s[0]
            if c in "\"'":
                m = (Y_DQ if c == '"' else Y_SQ).match(s)
                while not m:
                    if c == '"' and re.match(r'"(?:[^"\\]|\\.)*"', s):
                        self.fail("unknown escape in a quoted value")
                    self.i += 1
                    if self.i >= len(self.lines):
                        self.fail("unclosed quoted value", line)
                    nxt = self.lines[self.i]
                    if nxt.strip() and len(nxt) - len(nxt.lstrip(" ")) <= parent:
                        self.fail("unclosed quoted value", line)
                    s += "\n" + nxt
                    m = (Y_DQ if c == '"' else Y_SQ).match(s)
                if not expect:
                    self.fail("',' expected in a flow collection")
                s = s[m.end() :]
                expect = False
            elif c in "[{":
                if not expect:
                    self.fail("',' expected in a flow collection")
                stack.append(c)
                s = s[1:]
                expect = True
                continue
            elif c in "]}":
                if not stack or stack.pop() != ("[" if c == "]" else "{"):
                    self.fail(f"unexpected {c!r}")
                s, expect = s[1:], False
            elif c == ",":
                if expect and not stack:
                    self.fail("unexpected ','")
                if expect == "comma":
                    self.fail("unexpected ','")
                s, expect = s[1:], "comma"
                continue
            elif c == ":" and (len(s) == 1 or s[1] in " \t,]}\"'"):
                s, expect = s[1:], True
                continue
            else:
                if not expect:
                    self.fail("',' expected in a flow collection")
                m = re.match(r"(?:[^,\[\]{}:#]|:(?![ \t,\[\]{}]|$)|(?<=\S)#)+", s)
                if not m:
                    self.fail(f"unexpected {c!r}")
                s = s[m.end() :]
                expect = False
            if not stack:
                return s


class _YamlBad(Exception):
    def __init__(self, cause: str, line: int):
        super().__init__(cause)
        self.cause, self.line = cause, line


PLAIN_START = re.compile(r"""[^\s\-?:,\[\]{}#&*!|>'"%@`]|[\-?:](?=[^\s])|\*|&|!""")
COLON = re.compile(r":(?=[ \t]|$)")


def _plain_key(body: str) -> re.Match | None:
    """The match of the first ': ' if a plain key stands before it."""
    if not PLAIN_START.match(body):
        return None
    m = COLON.search(body)
    if not m:
        return None
    cut = body.find(" #")
    if 0 <= cut < m.start():
        return None
    key = body[: m.start()]
    if Y_PROPS.match(key) and re.match(r"(?:[&!]\S*[ \t]+)+[\"']", key):
        pass
    return re.compile(r"[\s\S]{%d}" % m.end()).match(body)


def check_yaml(text: str) -> list[Error]:
    y = _Yaml(text)
    errors: list[Error] = []
    m = re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text)
    if m:
        errors.append(Error(text.count("\n", 0, m.start()) + 1, "control character"))
    try:
        y.document()
    except _YamlBad as e:
        y.errors.append(Error(e.line, e.cause))
    except RecursionError:
        y.errors.append(Error(1, "nested too deeply"))
    return errors + y.errors
