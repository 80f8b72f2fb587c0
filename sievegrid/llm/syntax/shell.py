"""Bash."""

from __future__ import annotations

import re

from .base import Bad, Error, remember

# Reserved words.
RESERVED = {"if", "then", "elif", "else", "fi", "for", "in", "do", "done", "while", "until", "case", "esac", "function", "select", "{", "}", "!", "[[", "]]", "time", "coproc"}
CLOSERS = {"then", "elif", "else", "fi", "do", "done", "esac", "}"}

ENDS = {"if": "fi", "for": "done", "select": "done", "while": "done", "until": "done", "case": "esac", "{": "}", "(": ")"}

OPERATOR = re.compile(r";;&|;;|;&|&&|\|\||\|&|&>>|&>|<<<|<<-|<<|<>|>>|>&|<&|>\||[;&|<>()\n]")
PLAIN = re.compile(r"[^\s;&|<>()'\"`$\\#]+|#")
ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")
SPACE = re.compile(r"(?:[ \t]|\\\n)+")
NAME = re.compile(r"[A-Za-z_][\w-]*\Z")

_words: dict[str, tuple] = {}


class _Lexer:
    """Words and operators; substitutions inside words are parsed as they are met."""

    def __init__(self, text: str):
        self.s, self.i, self.line = text, 0, 1
        self.toks: list[tuple[str, str, int]] = []  # kind (w: plain word, q: word with quotes or expansions, op), text, line
        self.heredocs: list[tuple[str, bool]] = []
        self.errors: list[Error] = []

    def bad(self, cause: str):
        raise Bad(cause, self.s.count("\n", 0, self.i) + 1)

    def run(self) -> list[tuple[str, str, int]]:
        """All tokens; behind an error, those from the end of its line on."""
        last = -1
        while True:
            try:
                return self.scan()
            except Bad as e:
                self.errors.append(Error(max(1, e.at), e.cause))
                stop = self.s.find("\n", max(self.i, last + 1))
                self.i = last = len(self.s) if stop < 0 else stop

    def scan(self) -> list[tuple[str, str, int]]:
        s, n = self.s, len(self.s)
        line, seen = s.count("\n", 0, self.i) + 1, self.i
        cond = False  # between [[ and ]]
        while self.i < n:
            if m := SPACE.match(s, self.i):
                self.i = m.end()
                continue
            line += s.count("\n", seen, self.i)
            seen = self.i
            c = s[self.i]
            if c == "#":
                stop = s.find("\n", self.i)
                self.i = n if stop < 0 else stop
                continue
            if c == "(" and s.startswith("((", self.i) and self.arithmetic_place():
                end = self.arithmetic(self.i + 2)
                if end:
                    self.toks.append(("q", "((", line))
                    self.i = end
                    continue
            m = OPERATOR.match(s, self.i)
            if m and not (m[0] in ("<", ">") and s[self.i + 1 : self.i + 2] == "("):
                op = m[0]
                if cond and op in ("<", ">", "(", ")", "&&", "||", "|", "\n"):
                    self.i = m.end()
                    if op != "\n":
                        self.toks.append(("q", op, line))
                    continue
                self.i = m.end()
                if op == "\n" and self.heredocs:
                    self.here()
                self.toks.append(("op", op, line))
                if op in ("<<", "<<-"):
                    self.i = SPACE.match(s, self.i).end() if SPACE.match(s, self.i) else self.i
                    start = self.i
                    self.word()
                    raw = s[start : self.i]
                    if not raw:
                        self.bad("here-document delimiter expected")
                    self.heredocs.append((re.sub(r"[\\'\"]", "", raw), op == "<<-"))
                    self.toks.append(("q", raw, line))
                continue
            start = self.i
            plain = self.word()
            text = s[start : self.i]
            if text == "[[" and self.command_place():
                cond = True
            elif text == "]]":
                cond = False
            self.toks.append(("w" if plain else "q", text, line))
            if ASSIGN.fullmatch(text) and s[self.i : self.i + 1] == "(":
                self.array()
                self.toks[-1] = ("q", text + "()", line)
        if self.heredocs:
            pass  # a here-document that ends with the file is only warned of
        return self.toks

    def command_place(self) -> bool:
        return not self.toks or self.toks[-1][0] == "op" and self.toks[-1][1] not in ("<", ">", ">>", "<<<") or self.toks[-1][1] in ("if", "then", "elif", "else", "do", "while", "until", "!", "{")

    def arithmetic_place(self) -> bool:
        return self.command_place() or self.toks[-1][1] == "for"

    def arithmetic(self, at: int) -> int:
        depth, i, s = 2, at, self.s
        while i < len(s) and depth:
            c = s[i]
            if c == "\\":
                i += 2
                continue
            depth += (c == "(") - (c == ")")
            if depth == 1 and c == ")" and s[i + 1 : i + 2] != ")":
                return 0
            i += 1
        return 0 if depth else i

    def array(self) -> None:
        s = self.s
        self.i += 1
        while self.i < len(s):
            c = s[self.i]
            if c in " \t\n":
                self.i += 1
            elif c == "#":
                stop = s.find("\n", self.i)
                self.i = len(s) if stop < 0 else stop
            elif c == ")":
                self.i += 1
                return
            elif c in ";&|<>(" and not s.startswith(("<(", ">("), self.i):
                self.bad(f"unexpected {c!r} in an array")
            elif c == "\\" and s[self.i + 1 : self.i + 2] == "\n":
                self.i += 2
            else:
                self.word()
        self.bad("unclosed array")

    def here(self) -> None:
        s = self.s
        for end, strip in self.heredocs:
            while self.i < len(s):
                stop = s.find("\n", self.i)
                stop = len(s) if stop < 0 else stop
                row = s[self.i : stop]
                self.i = min(len(s), stop + 1)
                if (row.lstrip("\t") if strip else row) == end:
                    break
        self.heredocs = []

    def word(self) -> bool:
        """Moves behind a word; whether it is free of quotes and expansions."""
        s, n, plain = self.s, len(self.s), True
        while self.i < n:
            if m := PLAIN.match(s, self.i):
                self.i = m.end()
                continue
            c = s[self.i]
            if c in " \t\n;&|" or c in "()" and not (self.i and s[self.i - 1] in "@?*+!" and c == "(" and plain and self.i > 1 and s[self.i - 2] not in " \t\n$"):
                break
            if c == "(":
                depth = 0
                while self.i < n:
                    depth += (s[self.i] == "(") - (s[self.i] == ")")
                    self.i += 1
                    if not depth:
                        break
                continue
            if c in "<>":
                if s.startswith(("<(", ">("), self.i):
                    self.i += 2
                    self.substitution()
                    plain = False
                    continue
                break
            plain = False
            if c == "\\":
                self.i += 2
            elif c == "'":
                stop = s.find("'", self.i + 1)
                if stop < 0:
                    self.bad("unterminated single quote")
                self.i = stop + 1
            elif c == '"':
                self.double()
            elif c == "`":
                stop = self.i + 1
                while stop < n and s[stop] != "`":
                    stop += 2 if s[stop] == "\\" else 1
                if stop >= n:
                    self.bad("unterminated backquote")
                self.i = stop + 1
            elif c == "$":
                self.dollar()
            elif c in " \t":
                break
            else:
                self.i += 1
        return plain

    def double(self) -> None:
        s, n = self.s, len(self.s)
        start = self.i
        self.i += 1
        while self.i < n:
            c = s[self.i]
            if c == '"':
                self.i += 1
                return
            if c == "\\":
                self.i += 2
            elif c == "$":
                self.dollar(True)
            elif c == "`":
                stop = s.find("`", self.i + 1)
                if stop < 0:
                    break
                self.i = stop + 1
            else:
                m = re.compile(r'[^"\\$`]+').match(s, self.i)
                self.i = m.end()
        self.i = start
        self.bad("unterminated double quote")

    def dollar(self, quoted: bool = False) -> None:
        s = self.s
        if s.startswith("$((", self.i) and (end := self.arithmetic(self.i + 3)):
            self.i = end
        elif s.startswith("$(", self.i):
            self.i += 2
            self.substitution()
        elif s.startswith("${", self.i):
            start = self.i
            self.i += 2
            if self.s[self.i : self.i + 1] in ("}", " "):
                self.bad("bad substitution")
            while self.i < len(s):
                c = s[self.i]
                if c == "}":
                    self.i += 1
                    return
                if c == "\\":
                    self.i += 2
                elif c == "'" and not quoted:
                    stop = s.find("'", self.i + 1)
                    self.i = len(s) if stop < 0 else stop + 1
                elif c == '"':
                    self.double()
                elif c == "$":
                    self.dollar(quoted)
                else:
                    self.i += 1
            self.i = start
            self.bad("unclosed '${'")
        elif s.startswith("$'", self.i) and not quoted:
            m = re.compile(r"\$'(?:[^'\\]|\\[\s\S])*'").match(s, self.i)
            if not m:
                self.bad("unterminated $'")
            self.i = m.end()
        elif s.startswith('$"', self.i) and not quoted:
            self.i += 1
            self.double()
        else:
            self.i += 1

    def substitution(self) -> None:
        """A command substitution behind its opening bracket: the list inside is parsed too."""
        s, start, depth = self.s, self.i, 1
        i = self.i
        in_case = 0
        while i < len(s):
            c = s[i]
            if c == "\\":
                i += 2
                continue
            if c == "'":
                stop = s.find("'", i + 1)
                if stop < 0:
                    break
                i = stop + 1
                continue
            if c == '"':
                self.i = i
                self.double()
                i = self.i
                continue
            if c == "$" and s[i + 1 : i + 2] in "({":
                self.i = i
                self.dollar()
                i = self.i
                continue
            if c == "#" and s[i - 1] in " \t\n":
                stop = s.find("\n", i)
                i = len(s) if stop < 0 else stop
                continue
            if s.startswith("case ", i) and s[i - 1] in " \t\n;(":
                in_case += 1
            elif s.startswith("esac", i):
                in_case = max(0, in_case - 1)
            if c == "(":
                depth += 1
            elif c == ")" and not (in_case and depth == 1):
                depth -= 1
                if not depth:
                    inner = s[start:i]
                    self.i = i + 1
                    base = s.count("\n", 0, start)
                    for e in _check(inner, True):
                        self.errors.append(Error(e.line + base, e.cause))
                    return
            i += 1
        self.i = start
        self.bad("unclosed command substitution")


class Parser:
    def __init__(self, toks: list[tuple[str, str, int]]):
        self.t, self.i, self.depth = toks, 0, 0
        self.errors: list[Error] = []

    def peek(self) -> str:
        """The reserved word or operator here; 'word' for other words."""
        if self.i >= len(self.t):
            return ""
        kind, text, _ = self.t[self.i]
        return text if kind == "op" or kind == "w" and text in RESERVED or text == "((" else "word"

    def fail(self, cause: str):
        line = self.t[min(self.i, len(self.t) - 1)][2] if self.t else 1
        raise Bad(cause, line)

    def newlines(self) -> None:
        while self.peek() == "\n":
            self.i += 1

    def need(self, tok: str) -> None:
        if self.peek() != tok:
            self.fail(f"expected {tok!r}")
        self.i += 1

    def list(self, closers: frozenset) -> None:
        """Commands up to a closer; at least one."""
        self.newlines()
        if self.peek() in closers or not self.peek():
            self.fail("command expected")
        self.depth += 1
        while True:
            start = self.peek()
            try:
                self.andor()
                if (tok := self.peek()) and tok not in (";", "&", "\n") and tok not in closers:
                    self.fail(f"unexpected {self.t[self.i][1]!r}")
            except Bad as e:
                if not self.recover(e, start, closers):
                    self.depth -= 1
                    raise
            if self.peek() not in (";", "&", "\n"):
                break
            self.i += 1
            self.newlines()
            if self.peek() in closers or not self.peek():
                break
        self.depth -= 1

    def recover(self, bad: Bad, start: str, closers: frozenset) -> bool:
        """Moves behind an error to the next separator, or the closer of this list; False if an outer list has to."""
        e = Error(max(1, bad.at), bad.cause)
        if e not in self.errors:
            self.errors.append(e)
        tok, end = self.peek(), ENDS.get(start)
        if tok in closers:
            return True
        if end and (tok == end or tok in CLOSERS):
            # The rest of the command that began here, if its end is there.
            i, nested = self.i, 0
            while i < len(self.t):
                word = self.t[i][1]
                if word == end:
                    if not nested:
                        self.i = i + 1
                        break
                    nested -= 1
                nested += ENDS.get(word) == end
                i += 1
            else:
                if self.depth > 1:
                    return False
        elif self.depth > 1 and (not tok or tok in CLOSERS or tok in (")", ";;", ";&", ";;&")):
            return False
        while self.peek() and self.peek() not in (";", "&", "\n"):
            self.i += 1
            if self.peek() in closers:
                break
        return True

    def andor(self) -> None:
        self.pipeline()
        while self.peek() in ("&&", "||"):
            self.i += 1
            self.newlines()
            self.pipeline()

    def pipeline(self) -> None:
        while self.peek() in ("!", "time"):
            self.i += 1
        self.command()
        while self.peek() in ("|", "|&"):
            self.i += 1
            self.newlines()
            self.command()

    def command(self) -> None:
        tok = self.peek()
        if tok == "if":
            self.i += 1
            self.list(frozenset(["then"]))
            self.need("then")
            self.list(frozenset(["elif", "else", "fi"]))
            while self.peek() == "elif":
                self.i += 1
                self.list(frozenset(["then"]))
                self.need("then")
                self.list(frozenset(["elif", "else", "fi"]))
            if self.peek() == "else":
                self.i += 1
                self.list(frozenset(["fi"]))
            self.need("fi")
        elif tok in ("while", "until"):
            self.i += 1
            self.list(frozenset(["do"]))
            self.body()
        elif tok in ("for", "select"):
            self.i += 1
            if self.peek() == "((":
                self.i += 1
            else:
                if self.i >= len(self.t) or not NAME.match(self.t[self.i][1]):
                    self.fail("name expected")
                self.i += 1
                self.newlines()
                if self.peek() == "in":
                    self.i += 1
                    while self.i < len(self.t) and self.t[self.i][0] != "op":
                        self.i += 1
            if self.peek() == ";":
                self.i += 1
            elif self.peek() not in ("\n", "do", "{"):
                self.fail("expected 'do'")
            self.newlines()
            self.body()
        elif tok == "case":
            self.i += 2
            self.newlines()
            self.need("in")
            self.newlines()
            while self.peek() != "esac":
                if self.peek() == "(":
                    self.i += 1
                while True:
                    if self.i >= len(self.t) or self.t[self.i][0] == "op":
                        self.fail("pattern expected")
                    self.i += 1
                    if self.peek() != "|":
                        break
                    self.i += 1
                self.need(")")
                self.newlines()
                if self.peek() not in (";;", ";&", ";;&", "esac"):
                    self.list(frozenset([";;", ";&", ";;&", "esac"]))
                if self.peek() in (";;", ";&", ";;&"):
                    self.i += 1
                    self.newlines()
                elif self.peek() != "esac":
                    self.fail("expected ';;'")
            self.i += 1
        elif tok == "{":
            self.i += 1
            self.list(frozenset(["}"]))
            self.need("}")
        elif tok == "(":
            self.i += 1
            self.list(frozenset([")"]))
            self.need(")")
        elif tok == "((":
            self.i += 1
        elif tok == "[[":
            self.i += 1
            start = self.i
            while self.peek() != "]]":
                if self.peek() in ("", "\n", ";"):
                    self.fail("expected ']]'")
                self.i += 1
            if self.i == start:
                self.fail("condition expected")
            self.i += 1
        elif tok == "function":
            self.i += 2
            if self.peek() == "(":
                self.i += 1
                self.need(")")
            self.newlines()
            self.compound()
        elif tok in CLOSERS or tok in ("", "in") or tok not in ("word", "]]", "coproc", "<", ">", ">>", "<<", "<<-", "<<<", "&>", "&>>", ">&", "<&", "<>", ">|"):
            if tok == "in":
                self.simple()
                return
            self.fail(f"unexpected {tok!r}" if tok.strip() else "unexpected end of line" if tok else "unexpected end of file")
        else:
            self.simple()
            return
        self.redirections()

    def compound(self) -> None:
        if self.peek() not in ("{", "(", "if", "for", "while", "until", "case", "[[", "((", "select"):
            self.fail("function body expected")
        self.command()

    def body(self) -> None:
        if self.peek() == "{":
            self.command()
            return
        self.need("do")
        self.list(frozenset(["done"]))
        self.need("done")

    def redirections(self) -> None:
        while self.i < len(self.t):
            tok = self.t[self.i]
            if tok[0] != "op" and tok[1].isdigit() and self.i + 1 < len(self.t) and self.t[self.i + 1][1] in ("<", ">", ">>", ">&", "<&"):
                self.i += 1
                continue
            if tok[0] == "op" and tok[1] in ("<", ">", ">>", "<<", "<<-", "<<<", "&>", "&>>", ">&", "<&", "<>", ">|"):
                self.redirect()
                continue
            return

    def redirect(self) -> None:
        self.i += 1
        if self.i >= len(self.t) or self.t[self.i][0] == "op":
            self.fail("redirection target expected")
        self.i += 1

    def simple(self) -> None:
        words = 0
        while self.i < len(self.t):
            kind, text, _ = self.t[self.i]
            if kind != "op":
                words += 1
                self.i += 1
                continue
            if text in ("<", ">", ">>", "<<", "<<-", "<<<", "&>", "&>>", ">&", "<&", "<>", ">|"):
                self.redirect()
                continue
            if text == "(":
                if words == 1 and self.i + 1 < len(self.t) and self.t[self.i + 1][1] == ")":
                    self.i += 2
                    self.newlines()
                    self.compound()
                    self.redirections()
                    return
                self.fail("unexpected '('")
            return


def _check(text: str, inner: bool = False) -> list[Error]:
    lexer, p = _Lexer(text), None
    extra: list[Error] = []
    try:
        toks = lexer.run()
        p = Parser(toks)
        p.newlines()
        while p.i < len(toks):
            p.list(frozenset())
            if p.i < len(toks):
                p.fail(f"unexpected {toks[p.i][1]!r}")
    except Bad as e:
        extra = [Error(max(1, e.at), e.cause)]
    except RecursionError:
        extra = [Error(1, "nested too deeply")]
    found = lexer.errors + (p.errors if p else []) + extra
    return sorted(dict.fromkeys(found), key=lambda e: e.line)


SHAPE_WORD = re.compile(r"(?<![\w$-])(?!(?:if|then|elif|else|fi|for|in|do|done|while|until|case|esac|function|select|time|coproc)(?![\w-]))[A-Za-z][\w-]*")
SHAPE_NUMBER = re.compile(r"\d+(?:\.\d+)*")
COMMENT = re.compile(r"(?m)^[ \t]*#.*$")
INDENT = re.compile(r"(?m)^[ \t]+")


def check_shell(text: str) -> list[Error]:
    """Errors of a script; as one shape of names and numbers repeats, their lines are kept with it."""
    if "\r" in text:
        text = text.replace("\r\n", "\n")
    if "<<" in text:
        return _check(text)
    shape = SHAPE_NUMBER.sub("0", SHAPE_WORD.sub("n", INDENT.sub("", COMMENT.sub("", text))))
    got = _words.get(shape)
    if got is None:
        got = remember(_words, shape, tuple(_check(shape)))
    return list(got)
