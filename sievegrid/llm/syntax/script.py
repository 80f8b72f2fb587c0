"""ECMAScript modules and TypeScript."""

from __future__ import annotations

import re

from .base import Bad, Cursor, Error, remember

# Reserved words; words that are names except where the grammar asks for them.
RESERVED = "await break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield".split()
CONTEXTUAL = "async of as from get set static let type interface declare namespace module abstract readonly public private protected override implements keyof infer is satisfies asserts unique accessor global out".split()

NAMES = {"n", *CONTEXTUAL}
LITERALS = re.compile(
    r"""(?P<comment>//[^\n]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<openblock>/\*)|(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<tpl>`)|(?P<regex>/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*)|(?P<bad>["'])""",
    re.X,
)
SIMPLE_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`")
NUMBER = re.compile(r"(?<![\w$.])(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|(?:0|[1-9](?:_?\d)*)n)(?![\w$])")
NAME = re.compile(r"(?<![\w$])(?!(?:" + "|".join(RESERVED + CONTEXTUAL) + r")(?![\w$]))(?:[^\W\d]|\$)[\w$]*")
TOKEN = re.compile(r"([ \t\f\v]*\n\s*|[ \t\f\v]+)?(>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|[+\-*/%&|^<>=!]=|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|<<|[A-Za-z]+|#n|[()\[\]{},:;.=+\-*/%@&|^~<>?!`\"0]|\S)")
REGEX_AFTER = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>\n]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do))[ \t\n]*\Z")

BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
MODIFIERS = {"public", "private", "protected", "readonly", "abstract", "override", "declare", "static", "accessor"}

_lines: dict[tuple, bool] = {}
_files: dict[tuple, bool] = {}
_fields: dict[tuple, bool] = {}


class Parser(Cursor):
    """Expressions return a kind: "name", "ref", "pattern" (object or array literal), "call", "" (not assignable)."""

    def __init__(self, toks: list[str], nl: list[bool], ts: bool):
        super().__init__(toks)
        self.nl, self.ts = nl, ts
        self.no_in = self.ambient = False

    def newline(self) -> bool:
        return self.i < self.n and self.nl[self.i]

    def semicolon(self) -> None:
        if self.take(";") or self.peek() in ("}", "") or self.newline():
            return
        self.fail("';' expected")

    # Expressions.
    def expression(self) -> str:
        kind = self.assign()
        while self.take(","):
            self.assign()
            kind = ""
        return kind

    def arrow_ahead(self) -> bool:
        """At '(': whether its closing bracket is followed by '=>' (or, in TypeScript, by ': type =>')."""
        depth, j = 0, self.i
        while j < self.n:
            c = self.t[j]
            depth += (c in ("(", "[", "{")) - (c in (")", "]", "}"))
            if depth == 0:
                break
            j += 1
        nxt = self.t[j + 1] if j + 1 < self.n else ""
        if nxt == "=>":
            return not self.nl[j + 1]
        if self.ts and nxt == ":":
            at, self.i = self.i, j + 2
            try:
                self.type_()
                return self.peek() == "=>"
            except Bad:
                return False
            finally:
                self.i = at
        return False

    def assign(self) -> str:
        tok = self.peek()
        if tok == "yield":
            self.i += 1
            if not self.newline() and self.peek() not in (")", "]", "}", ",", ";", ":", ""):
                self.take("*")
                self.assign()
            return ""
        if tok == "async" and not (self.i + 1 < self.n and self.nl[self.i + 1]):
            if self.ahead() in NAMES and self.ahead(2) == "=>":
                self.i += 2
                self.arrow_body()
                return ""
            if self.ahead() == "(":
                self.i += 1
                if self.arrow_ahead():
                    self.arrow()
                    return ""
                self.i -= 1
        if tok in NAMES and self.ahead() == "=>":
            self.i += 1
            self.arrow_body()
            return ""
        if tok == "(" and self.arrow_ahead():
            self.arrow()
            return ""
        if tok == "<" and self.ts:
            at = self.i
            try:
                self.type_parameters()
                if self.peek() == "(" and self.arrow_ahead():
                    self.arrow()
                    return ""
            except Bad:
                pass
            self.i = at
        kind = self.conditional()
        op = self.peek()
        if op in ASSIGN:
            if kind not in ("name", "ref") and not (kind == "pattern" and op == "="):
                self.fail("invalid assignment target")
            self.i += 1
            self.assign()
            return ""
        if op == ">" and self.t[self.i : self.i + 3] in ([">", ">", "="], [">", ">=", ""]):
            self.fail("unexpected token")
        return kind

    def arrow(self) -> None:
        self.parameters()
        if self.ts and self.take(":"):
            self.type_()
        self.arrow_body()

    def arrow_body(self) -> None:
        if self.newline():
            self.fail("newline before '=>'")
        self.need("=>")
        if self.peek() == "{":
            self.block()
        else:
            self.assign()

    def conditional(self) -> str:
        kind = self.binary(1)
        if self.peek() == "?":
            self.i += 1
            keep, self.no_in = self.no_in, False
            self.assign()
            self.no_in = keep
            self.need(":")
            self.assign()
            return ""
        return kind

    def operator(self) -> tuple[str, int]:
        """The operator here and its tokens: '>' comes in single tokens, for types' sake."""
        op = self.peek()
        if op == ">" and self.ahead() == ">" and not self.nl[self.i + 1]:
            if self.ahead(2) == ">":
                return ">>>", 3
            return ">>", 2
        return op, 1

    def binary(self, level: int) -> str:
        """Precedence climbing."""
        kind = self.unary()
        while True:
            op, width = self.operator()
            if op in ("as", "satisfies") and self.ts and not self.newline():
                self.i += 1
                if not self.take("const"):
                    self.type_()
                continue
            p = BINARY.get(op, 0)
            if p < level or op == "in" and self.no_in:
                return kind
            self.i += width
            self.binary(p if op == "**" else p + 1)
            kind = ""

    def unary(self) -> str:
        tok = self.peek()
        if tok in ("+", "-", "!", "~", "typeof", "void", "delete", "await"):
            self.i += 1
            self.unary()
            return ""
        if tok in ("++", "--"):
            self.i += 1
            if self.unary() not in ("name", "ref"):
                self.fail("invalid increment operand")
            return ""
        if tok == "<" and self.ts:
            self.i += 1
            self.type_()
            self.need(">")
            return self.unary()
        kind = self.postfix()
        if self.peek() in ("++", "--") and not self.newline():
            if kind not in ("name", "ref"):
                self.fail("invalid increment operand")
            self.i += 1
            return ""
        return kind

    def postfix(self) -> str:
        kind = self.primary()
        while True:
            tok = self.peek()
            if tok == ".":
                self.i += 1
                self.property_name()
                kind = "ref"
            elif tok == "?.":
                self.i += 1
                if self.peek() == "(":
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif self.peek() != "`":
                    self.property_name()
                kind = ""
            elif tok == "[":
                self.i += 1
                keep, self.no_in = self.no_in, False
                self.expression()
                self.no_in = keep
                self.need("]")
                kind = "ref"
            elif tok == "(":
                self.arguments()
                kind = "call"
            elif tok == "`":
                self.i += 1
                kind = ""
            elif tok == "!" and self.ts and not self.newline() and self.ahead() not in ("=", "=="):
                self.i += 1
            elif tok == "<" and self.ts and self.type_call():
                kind = "call"
            else:
                return kind

    def type_call(self) -> bool:
        """Type arguments before a call or template."""
        at = self.i
        try:
            self.type_arguments()
            if self.peek() in ("(", "`"):
                if self.peek() == "(":
                    self.arguments()
                return True
        except Bad:
            pass
        self.i = at
        return False

    def property_name(self) -> None:
        tok = self.peek()
        if tok in NAMES or tok in _RESERVED or tok == "#n":
            self.i += 1
            return
        self.fail("property name expected")

    def arguments(self) -> None:
        self.need("(")
        keep, self.no_in = self.no_in, False
        while not self.take(")"):
            self.take("...")
            self.assign()
            if not self.take(","):
                self.need(")")
                break
        self.no_in = keep

    def primary(self) -> str:
        tok = self.peek()
        if tok == "async" and self.ahead() == "function" and not self.nl[self.i + 1]:
            self.i += 1
            self.function(False)
            return ""
        self.i += 1
        if tok in NAMES:
            return "name"
        if tok in ('"', "0", "`", "null", "true", "false", "this", "/"):
            if tok == "/":
                self.i -= 1
                self.fail("expression expected")
            return ""
        if tok == "super":
            if self.peek() not in (".", "[", "("):
                self.fail("'super' keyword unexpected here")
            return ""
        if tok == "#n":
            if self.peek() != "in":
                self.fail("private name unexpected here")
            return ""
        if tok == "import":
            if self.take("."):
                self.property_name()
            elif self.peek() != "(":
                self.fail("unexpected import")
            return ""
        if tok == "(":
            keep, self.no_in = self.no_in, False
            kind = self.expression()
            self.no_in = keep
            self.need(")")
            return kind if kind != "pattern" else ""
        if tok == "[":
            keep, self.no_in = self.no_in, False
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.assign()
                if self.peek() != "]":
                    self.need(",")
            self.no_in = keep
            return "pattern"
        if tok == "{":
            keep, self.no_in = self.no_in, False
            self.object()
            self.no_in = keep
            return "pattern"
        self.i -= 1
        if tok == "function":
            self.function(False)
            return ""
        if tok == "class":
            self.class_(False)
            return ""
        if tok == "@":
            self.decorators()
            self.class_(False)
            return ""
        if tok == "new":
            self.i += 1
            if self.take("."):
                self.property_name()
                return ""
            if self.peek() == "new":
                self.primary()
                return ""
            self.primary()
            while True:
                if self.take("."):
                    self.property_name()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif self.peek() == "<" and self.ts:
                    self.type_arguments()
                else:
                    break
            if self.peek() == "(":
                self.arguments()
            return ""
        self.fail("expression expected")

    def key(self) -> str:
        """A property key; what it was."""
        tok = self.peek()
        if tok == "[":
            self.i += 1
            self.assign()
            self.need("]")
            return "["
        if tok in NAMES or tok in _RESERVED or tok in ('"', "0", "#n"):
            self.i += 1
            return tok
        self.fail("property name expected")

    def object(self) -> None:
        while not self.take("}"):
            if self.take("..."):
                self.assign()
            else:
                self.member_object()
            if not self.take(","):
                self.need("}")
                return

    def member_object(self) -> None:
        tok, nxt = self.peek(), self.ahead()
        if tok in ("get", "set", "async") and nxt not in (",", ":", "(", "}", "=", "<"):
            self.i += 1
        star = self.take("*")
        kind = self.key()
        if self.peek() in ("(", "<"):
            self.method()
            return
        if star or tok in ("get", "set", "async") and nxt not in (",", ":", "(", "}", "=", "<"):
            self.fail("'(' expected")
        if self.take(":"):
            self.assign()
        elif kind not in NAMES:
            self.fail("':' expected")
        elif self.take("="):
            self.assign()

    def method(self) -> None:
        if self.peek() == "<":
            if not self.ts:
                self.fail("unexpected '<'")
            self.type_parameters()
        self.parameters()
        if self.ts and self.take(":"):
            self.return_type()
        if self.ts and self.peek() != "{":
            self.semicolon()
            return
        self.block()

    def function(self, declared: bool) -> None:
        self.need("function")
        self.take("*")
        if self.peek() in NAMES:
            self.i += 1
        elif declared:
            self.fail("function name expected")
        if self.ts and self.peek() == "<":
            self.type_parameters()
        self.parameters()
        if self.ts and self.take(":"):
            self.return_type()
        if self.ts and declared and self.peek() != "{":
            self.semicolon()
            return
        self.block()

    def return_type(self) -> None:
        if self.peek() == "asserts" and self.ahead() in NAMES | {"this"} and not self.nl[self.i + 1]:
            self.i += 2
            if self.take("is"):
                self.type_()
            return
        self.type_()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.decorators()
            if self.ts:
                while self.peek() in MODIFIERS and (self.ahead() in NAMES or self.ahead() in ("{", "[")):
                    self.i += 1
            rest = self.take("...")
            if self.ts and self.take("this"):
                self.need(":")
                self.type_()
            else:
                self.binding()
                if self.ts:
                    self.take("?")
                    if self.take(":"):
                        self.type_()
                if self.take("="):
                    if rest:
                        self.fail("rest parameter with a default")
                    self.assign()
            if not self.take(","):
                self.need(")")
                return
            if rest:
                self.fail("rest parameter must be last")

    def binding(self) -> None:
        tok = self.peek()
        if tok in NAMES:
            self.i += 1
        elif tok == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assign()
                if self.peek() != "]":
                    self.need(",")
        elif tok == "{":
            self.i += 1
            while not self.take("}"):
                if self.take("..."):
                    self.binding()
                else:
                    kind = self.key()
                    if self.take(":"):
                        self.binding()
                    elif kind not in NAMES:
                        self.fail("':' expected")
                    if self.take("="):
                        self.assign()
                if not self.take(","):
                    self.need("}")
                    return
        else:
            self.fail("name expected")

    def decorators(self) -> None:
        while self.take("@"):
            self.postfix()

    def class_(self, declared: bool) -> None:
        self.need("class")
        if self.peek() in NAMES and self.peek() != "implements":
            self.i += 1
        elif declared:
            self.fail("class name expected")
        if self.ts and self.peek() == "<":
            self.type_parameters()
        if self.take("extends"):
            self.postfix()
            if self.ts and self.peek() == "<":
                self.type_arguments()
        if self.ts and self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            self.member()

    def member(self) -> None:
        self.decorators()
        if self.peek() == "static" and self.ahead() == "{":
            self.i += 1
            self.block()
            return
        stop = ("(", "=", ";", "}", ":", "?", "!", "<")
        while (self.peek() == "static" or self.ts and self.peek() in MODIFIERS or self.peek() == "accessor") and self.ahead() not in stop:
            self.i += 1
        if self.peek() in ("get", "set", "async") and self.ahead() not in stop and not (self.i + 1 < self.n and self.nl[self.i + 1]):
            self.i += 1
        star = self.take("*")
        if self.ts and self.peek() == "[" and self.ahead() in NAMES and self.ahead(2) == ":":
            self.i += 3
            self.type_()
            self.need("]")
            self.need(":")
            self.type_()
            self.semicolon()
            return
        self.key()
        if self.ts and not self.take("?"):
            self.take("!")
        if self.peek() in ("(", "<"):
            self.method()
            return
        if star:
            self.fail("'(' expected")
        if self.ts and self.take(":"):
            self.type_()
        if self.take("="):
            self.assign()
        self.semicolon()

    # Types.
    def type_(self) -> None:
        at = self.i
        if self.peek() == "(" and self.function_type_ahead() or self.peek() == "<":
            if self.peek() == "<":
                self.type_parameters()
            self.parameters()
            self.need("=>")
            self.return_type()
            return
        if self.peek() in ("new", "abstract") and (self.ahead() in ("(", "<", "new")):
            self.take("abstract")
            self.need("new")
            if self.peek() == "<":
                self.type_parameters()
            self.parameters()
            self.need("=>")
            self.type_()
            return
        self.take("|")
        self.take("&")
        self.type_operand()
        while self.peek() in ("|", "&"):
            self.i += 1
            self.type_operand()
        if self.peek() == "is" and self.i == at + 1 and not self.newline():
            self.i += 1
            self.type_()
        elif self.peek() == "extends" and not self.newline() and not self.in_constraint:
            self.i += 1
            self.type_()
            self.need("?")
            self.type_()
            self.need(":")
            self.type_()

    in_constraint = False

    def function_type_ahead(self) -> bool:
        depth, j = 0, self.i
        while j < self.n:
            depth += (self.t[j] in ("(", "[", "{")) - (self.t[j] in (")", "]", "}"))
            if depth == 0:
                return j + 1 < self.n and self.t[j + 1] == "=>"
            j += 1
        return False

    def type_operand(self) -> None:
        while self.peek() in ("keyof", "unique", "readonly", "infer") and (self.ahead() in NAMES | {"(", "[", "{", '"', "typeof"} and self.ahead() not in ("is",)):
            self.i += 1
        tok = self.peek()
        self.i += 1
        if tok in NAMES or tok in ("this", "void", "null", "true", "false", '"', "0", "`"):
            while self.take("."):
                self.property_name()
            if self.peek() == "<" and not self.newline():
                self.type_arguments()
        elif tok == "-" and self.peek() == "0":
            self.i += 1
        elif tok == "typeof":
            if self.take("import"):
                self.arguments()
            else:
                self.property_name()
            while self.take("."):
                self.property_name()
            if self.peek() == "<":
                self.type_arguments()
        elif tok == "import":
            self.arguments()
            while self.take("."):
                self.property_name()
            if self.peek() == "<":
                self.type_arguments()
        elif tok == "(":
            self.type_()
            self.need(")")
        elif tok == "[":
            while not self.take("]"):
                self.take("...")
                if self.peek() in NAMES and (self.ahead() == ":" or self.ahead() == "?" and self.ahead(2) == ":"):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type_()
                self.take("?")
                if not self.take(","):
                    self.need("]")
                    break
        elif tok == "{":
            self.type_body()
        else:
            self.i -= 1
            self.fail("type expected")
        while self.peek() == "[" and not self.newline():
            self.i += 1
            if not self.take("]"):
                self.type_()
                self.need("]")

    def type_body(self) -> None:
        """Members of an object type or interface, after '{'."""
        while not self.take("}"):
            if self.peek() in ("+", "-"):
                self.i += 1
            while self.peek() in ("readonly", "get", "set") and self.ahead() not in (":", "?", "(", ",", ";", "}", "<"):
                self.i += 1
            if self.take("["):
                if self.peek() in NAMES and self.ahead() == ":":
                    self.i += 2
                    self.type_()
                elif self.peek() in NAMES and self.ahead() == "in":
                    self.i += 2
                    self.type_()
                    if self.take("as"):
                        self.type_()
                else:
                    self.assign()
                self.need("]")
            elif self.peek() == "new" and self.ahead() in ("(", "<"):
                self.i += 1
            elif self.peek() not in ("(", "<"):
                self.key()
            if self.peek() in ("+", "-"):
                self.i += 1
            self.take("?")
            if self.peek() == "<":
                self.type_parameters()
            if self.peek() == "(":
                self.parameters()
            if self.take(":"):
                self.return_type()
            if not (self.take(";") or self.take(",") or self.peek() == "}" or self.newline()):
                self.fail("';' expected")

    def type_arguments(self) -> None:
        self.need("<")
        keep, self.in_constraint = self.in_constraint, False
        while True:
            self.type_()
            if not self.take(","):
                break
        self.in_constraint = keep
        self.need(">")

    def type_parameters(self) -> None:
        self.need("<")
        while True:
            while self.peek() in ("const", "in", "out") and self.ahead() in NAMES:
                self.i += 1
            if self.peek() not in NAMES:
                self.fail("type parameter expected")
            self.i += 1
            if self.take("extends"):
                self.type_()
            if self.take("="):
                self.type_()
            if not self.take(",") or self.peek() == ">":
                break
        self.need(">")

    # Statements.
    def block(self) -> None:
        self.need("{")
        keep, self.no_in = self.no_in, False
        while not self.take("}"):
            if self.i >= self.n:
                self.fail("'}' expected")
            self.statement()
        self.no_in = keep

    def program(self) -> None:
        while self.i < self.n:
            self.statement(True)

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self, top: bool = False) -> None:
        tok = self.peek()
        handler = _STATEMENTS.get(tok)
        if tok == "S":  # a line that is a run of statements
            self.i += 1
        elif handler:
            handler(self)
        elif tok in ("import",) and self.ahead() not in ("(", "."):
            self.imported()
        elif tok == "export":
            self.exported()
        elif tok == "async" and self.ahead() == "function" and not self.nl[self.i + 1]:
            self.i += 1
            self.function(True)
        elif tok == "let" and (self.ahead() in NAMES or self.ahead() in ("[", "{")):
            self.declaration(False)
            self.semicolon()
        elif self.ts and self.typed_statement(tok):
            pass
        elif tok in NAMES and self.ahead() == ":":
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.semicolon()

    def typed_statement(self, tok: str) -> bool:
        nxt = self.ahead()
        same = not (self.i + 1 < self.n and self.nl[self.i + 1])
        if tok == "interface" and nxt in NAMES and same:
            self.i += 2
            if self.peek() == "<":
                self.type_parameters()
            if self.take("extends"):
                self.type_()
                while self.take(","):
                    self.type_()
            self.need("{")
            self.type_body()
            return True
        if tok == "type" and nxt in NAMES and same and self.ahead(2) in ("=", "<"):
            self.i += 2
            if self.peek() == "<":
                self.type_parameters()
            self.need("=")
            self.type_()
            self.semicolon()
            return True
        if tok == "enum":
            self.enum()
            return True
        if tok in ("declare", "abstract") and same and (nxt in ("class", "const", "function", "var", "enum", "module", "namespace", "abstract", "global", "interface", "type", "let", "async")):
            self.i += 1
            if self.peek() == "global":
                self.i += 1
                self.block()
            else:
                keep, self.ambient = self.ambient, tok == "declare" or self.ambient
                self.statement()
                self.ambient = keep
            return True
        if tok in ("namespace", "module") and same and (nxt in NAMES or nxt == '"'):
            self.i += 2
            while self.take("."):
                self.property_name()
            if self.peek() == "{":
                self.block()
            else:
                self.semicolon()
            return True
        return False

    def enum(self) -> None:
        self.need("enum")
        if self.peek() not in NAMES:
            self.fail("name expected")
        self.i += 1
        self.need("{")
        while not self.take("}"):
            self.key()
            if self.take("="):
                self.assign()
            if not self.take(","):
                self.need("}")
                return

    def declaration(self, in_for: bool) -> None:
        constant = self.peek() == "const"
        self.i += 1
        if constant and self.ts and self.peek() == "enum":
            self.enum()
            return
        while True:
            pattern = self.peek() in ("[", "{")
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type_()
            if self.take("="):
                self.assign()
            elif (constant or pattern) and not (in_for and self.peek() in ("of", "in")) and not (self.ts and not pattern and not in_for and self.ambient):
                self.fail("missing initializer")
            if not self.take(","):
                return

    def if_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()
        if self.take("else"):
            self.statement()

    def for_(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if not self.take(";"):
            self.no_in = True
            if self.peek() in ("var", "const") or self.peek() == "let" and (self.ahead() in NAMES or self.ahead() in ("[", "{")):
                self.declaration(True)
                kind = "name"
            else:
                kind = self.expression()
            self.no_in = False
            if self.peek() in ("of", "in"):
                if kind not in ("name", "ref", "pattern"):
                    self.fail("invalid loop target")
                of = self.peek() == "of"
                self.i += 1
                self.assign() if of else self.expression()
                self.need(")")
                self.statement()
                return
            self.need(";")
        if self.peek() != ";":
            self.expression()
        self.need(";")
        if self.peek() != ")":
            self.expression()
        self.need(")")
        self.statement()

    def while_(self) -> None:
        self.i += 1
        self.condition()
        self.statement()

    def do_(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.take(";")

    def return_(self) -> None:
        self.i += 1
        if not self.newline() and self.peek() not in (";", "}", ""):
            self.expression()
        self.semicolon()

    def throw_(self) -> None:
        self.i += 1
        if self.newline():
            self.fail("newline after throw")
        self.expression()
        self.semicolon()

    def jump(self) -> None:
        self.i += 1
        if not self.newline() and self.peek() in NAMES:
            self.i += 1
        self.semicolon()

    def try_(self) -> None:
        self.i += 1
        self.block()
        done = False
        if self.take("catch"):
            done = True
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type_()
                self.need(")")
            self.block()
        if self.take("finally"):
            done = True
            self.block()
        if not done:
            self.fail("'catch' or 'finally' expected")

    def switch_(self) -> None:
        self.i += 1
        self.condition()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while self.peek() not in ("case", "default", "}"):
                if self.i >= self.n:
                    self.fail("'}' expected")
                self.statement()

    def declare_(self) -> None:
        self.declaration(False)
        if self.t[self.i - 1] != "}" or self.peek() == ";":
            self.semicolon()

    def class_statement(self) -> None:
        self.decorators()
        if self.peek() == "export":
            self.exported()
            return
        if self.ts:
            self.take("abstract")
        self.class_(True)

    def empty(self) -> None:
        self.i += 1

    def debugger_(self) -> None:
        self.i += 1
        self.semicolon()

    def with_(self) -> None:
        self.fail("'with' in a module")

    def specifiers(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.ts and self.peek() == "type" and self.ahead() not in (",", "}", "as"):
                self.i += 1
            if not self.take('"'):
                self.property_name()
            if self.take("as") and not self.take('"'):
                self.property_name()
            if not self.take(","):
                self.need("}")
                return

    def source(self) -> None:
        self.need("from")
        self.need('"')
        if self.take("with"):
            self.object_after()
        self.semicolon()

    def object_after(self) -> None:
        self.need("{")
        self.object()

    def imported(self) -> None:
        self.i += 1
        if self.take('"'):
            self.semicolon()
            return
        if self.ts and self.peek() == "type" and (self.ahead() in NAMES and self.ahead() != "from" or self.ahead() in ("{", "*")):
            self.i += 1
        if self.peek() in NAMES:
            self.i += 1
            if self.ts and self.take("="):
                self.postfix()
                self.semicolon()
                return
            if self.peek() == "from":
                self.source()
                return
            self.need(",")
        if self.take("*"):
            self.need("as")
            if self.peek() not in NAMES:
                self.fail("name expected")
            self.i += 1
        else:
            self.specifiers()
        self.source()

    def exported(self) -> None:
        self.i += 1
        tok = self.peek()
        if tok == "default":
            self.i += 1
            if self.peek() == "function":
                self.function(False)
            elif self.peek() == "async" and self.ahead() == "function":
                self.i += 1
                self.function(False)
            elif self.peek() in ("class", "@") or self.ts and self.peek() == "abstract" and self.ahead() == "class":
                self.decorators()
                self.take("abstract")
                self.class_(False)
            elif self.ts and self.peek() == "interface":
                self.statement()
            else:
                self.assign()
                self.semicolon()
        elif tok == "*":
            self.i += 1
            if self.take("as") and not self.take('"'):
                self.property_name()
            self.source()
        elif tok == "{" or self.ts and tok == "type" and self.ahead() in ("{", "*"):
            self.take("type")
            if self.take("*"):
                self.source()
                return
            self.specifiers()
            if self.peek() == "from":
                self.source()
            else:
                self.semicolon()
        elif self.ts and tok in ("=", "as", "import"):
            self.i += 1
            self.expression() if tok == "=" else self.statement()
            self.semicolon() if tok == "=" else None
        elif tok in ("var", "const", "let", "function", "class", "async", "@") or self.ts and tok in ("interface", "type", "enum", "declare", "abstract", "namespace", "module"):
            self.statement()
        else:
            self.fail("declaration expected after export")


_RESERVED = set(RESERVED)
_STATEMENTS = {
    "{": Parser.block, ";": Parser.empty, "if": Parser.if_, "for": Parser.for_, "while": Parser.while_, "do": Parser.do_, "return": Parser.return_, "throw": Parser.throw_,
    "break": Parser.jump, "continue": Parser.jump, "try": Parser.try_, "switch": Parser.switch_, "var": Parser.declare_, "const": Parser.declare_, "class": Parser.class_statement,
    "@": Parser.class_statement, "debugger": Parser.debugger_, "with": Parser.with_,
    "function": lambda p: p.function(True),
}


def _tokens(shape: str) -> tuple[list[str], list[bool]]:
    toks, nl = [], []
    for space, tok in TOKEN.findall(shape):
        toks.append(tok)
        nl.append("\n" in space)
    return toks, nl


def _template(text: str, at: int, bad: list, ts: bool) -> int:
    """The end of a template whose content starts at `at`; its fields are parsed as expressions."""
    m = SIMPLE_TPL.match(text, at)
    if m:
        return m.end()
    i = at
    while i < len(text):
        c = text[i]
        if c == "`":
            return i + 1
        if c == "\\":
            i += 2
        elif c == "$" and text[i + 1 : i + 2] == "{":
            depth, j = 1, i + 2
            while j < len(text) and depth:
                d = text[j]
                if d == "`":
                    j = _template(text, j + 1, bad, ts)
                    if j < 0:
                        return -1
                    continue
                if d in "\"'":
                    e = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'').match(text, j)
                    j = e.end() if e else j + 1
                    continue
                depth += (d == "{") - (d == "}")
                j += 1
            if depth:
                return -1
            inner = text[i + 2 : j - 1]
            if not re.fullmatch(r"[\w.$]+", inner) and not _field(inner, ts):
                bad.append((i, "invalid field in template"))
            i = j
        else:
            i += 1
    return -1


def _field(inner: str, ts: bool) -> bool:
    shape, bad = _shape(inner, ts)
    if bad:
        return False
    got = _fields.get((shape, ts))
    if got is None:
        toks, nl = _tokens(shape)
        p = Parser(toks, nl, ts)
        try:
            p.expression()
            got = p.i >= p.n
        except (Bad, RecursionError):
            got = False
        remember(_fields, (shape, ts), got)
    return got


def _shape(text: str, ts: bool) -> tuple[str, list[tuple[int, str]]]:
    bad: list[tuple[int, str]] = []
    out, at = [], 0
    search = LITERALS.search
    while m := search(text, at):
        out.append(text[at : m.start()])
        start, at = m.start(), m.end()
        kind = m.lastgroup
        if kind == "comment":
            continue
        if kind == "block":
            out.append("\n" * m.group().count("\n") or " ")
        elif kind == "str":
            out.append('"' + "\x01" * m.group().count("\n"))
        elif kind == "tpl":
            end = _template(text, at, bad, ts)
            if end < 0:
                bad.append((start, "unterminated template"))
                end = len(text)
            out.append("`" + "\x01" * text.count("\n", start, end))
            at = end
        elif kind == "regex":
            before = "".join(out[-3:])[-40:]
            if REGEX_AFTER.search(before):
                out.append('"')
            else:
                out.append("/")
                at = start + 1
        elif kind == "openblock":
            bad.append((start, "unterminated comment"))
            at = len(text)
        else:
            bad.append((start, "unterminated string"))
            out.append('"')
            stop = text.find("\n", at)
            at = len(text) if stop < 0 else stop
    out.append(text[at:])
    return NAME.sub("n", NUMBER.sub("0", "".join(out))), bad


def _line(shape: str, ts: bool) -> bool:
    """Whether a line on its own is a run of whole statements that ends with ';'."""
    got = _lines.get((shape, ts))
    if got is None:
        toks, nl = _tokens(shape)
        got = False
        # What may also be a class member or a type's member keeps its tokens.
        if toks and toks[-1] == ";" and toks[0] not in ("import", "export") and not (toks[0] in NAMES and len(toks) > 1 and (toks[1] in ("=", ":", "?", "!", ";") or toks[1] in NAMES)):
            p = Parser(toks, nl, ts)
            try:
                p.program()
                got = True
            except (Bad, RecursionError):
                got = False
        remember(_lines, (shape, ts), got)
    return got


def check_script(text: str, ts: bool) -> list[Error]:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("#!"):
        text = "//" + text[2:]
    shape, bad = _shape(text, ts)
    errors = [Error(text.count("\n", 0, at) + 1, cause) for at, cause in bad]
    toks: list[str] = []
    nl: list[bool] = []
    where: list[int] = []
    depth, line = 0, 0
    for raw in shape.split("\n"):
        line += 1
        body = raw.strip()
        if "\x01" in body:
            extra = body.count("\x01")
            body = body.replace("\x01", " ")
        else:
            extra = 0
        if body:
            if depth == 0 and body[-1] == ";" and _line(body, ts):
                toks.append("S")
                nl.append(True)
                where.append(line)
            else:
                a, b = _tokens(body)
                if a:
                    b[0] = True
                    toks += a
                    nl += b
                    where += [line] * len(a)
                    depth += sum(x in ("(", "[") for x in a) - sum(x in (")", "]") for x in a)
        line += extra
    key = ("\n".join(t + ("\n" if x else "") for t, x in zip(toks, nl)), ts)
    if _files.get(key):
        return sorted(errors)
    p = Parser(toks, nl, ts)
    while p.i < p.n:
        at = p.i
        try:
            p.program()
            if not errors:
                remember(_files, key, True)
        except (Bad, RecursionError) as e:
            k = min(e.at if isinstance(e, Bad) else p.i, p.n - 1)
            errors.append(Error(where[k] if p.n else 1, e.cause if isinstance(e, Bad) else "nested too deeply"))
            # Panic mode: go on behind the next ';' or at the next line that starts a declaration.
            k = max(k, at) + 1
            while k < p.n and not (nl[k] and toks[k] in ("export", "import", "function", "class", "const", "S")):
                k += 1
            p.i = k
            p.no_in = p.in_constraint = False
    return sorted(errors)
