import ast
import json
import subprocess
import tomllib
import warnings
from pathlib import Path

import pytest

from sievegrid.llm import sourcecheck, syntax

PYTHON = [
    "x = 1\n", "def f(a, *, b=2, **k) -> int:\n    return a\n", "if x:\npass\n", "print 'a'\n", "f(a b)\n", "x = (1,\n  2)\ny = [i for i in x if i]\n", "class A(B, metaclass=M):\n    x: int = 3\n", "try:\n    a()\n", "try:\n    a()\nexcept (E, F) as e:\n    pass\nelse:\n    b()\nfinally:\n    c()\n",
    "f() = 3\n", "a, *b = c\n", "lambda x, y=1: x\n", "with open(a) as f, b:\n    pass\n", "match x:\n    case [1, *r] if r:\n        pass\n    case _:\n        pass\n", "match = 3\nmatch.x\n", "x = 012\n", "x = 12abc\n", "s = 'abc\n", 's = """abc\n', "async def f():\n    await g()\n    async for i in j:\n        yield i\n",
    "@d\ndef f(): pass\n", "@d\nx = 1\n", "else:\n    pass\n", "for i in range(3): print(i)\nelse: pass\n", "\tif a:\n        b\n", "if a:\n\tb\n        c\n", "x = f'{a!r:>{w}} {b[\"c\"]}'\n", "x = f'{a b}'\n", "<<<<<<< HEAD\nx = 1\n=======\n", "x = {**a, 'b': 1}\ny = {*a, 1}\n", "del a[0], b.c\n", "del f()\n", "global a, b\n", "from . import (a, b as c,)\n", "from a import b,\n", "import a.b as c\n", "x = a if b else c\n", "x = a if b\n", "return\n", "x: int\n", "(a := 3)\n", "a := 3\n", "f(x for x in y)\n", "f(a=1, b)\n", "f(**k, *a)\n", "not a in b\n", "a not in b is not c\n", "-x ** -y\n", "x = [\n", "x = 1)\n", "def f(a=1, b): pass\n", "x = “a”\n", "raise A from b\n", "a\\\n+ b\n", "\x0cx = 1\n", "if a:\n    x\n  y\n", "type X = int\n", "x = 1; y = 2;\n", "", "# only a remark", "x = b'a' b'c'\n", "a[1:2, ::3, ...]\n",
]


@pytest.mark.parametrize("code", PYTHON)
def test_python_like_the_interpreter(code):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            compile(code, "x", "exec", ast.PyCF_ONLY_AST)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
    assert (not syntax.check("python", code)) == valid


def test_python_accepts_the_standard_library():
    root = Path(ast.__file__).parent
    files = sorted(root.glob("*.py"))[:120] + sorted((root / "asyncio").glob("*.py"))
    bad = [f.name for f in files if syntax.check("python", f.read_text(encoding="utf-8", errors="ignore"))]
    assert not bad


@pytest.mark.parametrize("text", ['{"a": [1, 2.5e3, true, null, "x\\u00e9"]}', "[1,]", "{'a': 1}", '{"a" 1}', "01", "", "[", '"\t"', '{"a":1}}', " 1 ", "[[[]]]", "nan", '{"a":1,"a":2}', "tru"])
def test_json_like_the_library(text):
    try:
        json.loads(text, parse_constant=lambda x: 1 / 0)
        valid = True
    except (ValueError, ZeroDivisionError):
        valid = False
    assert (not syntax.check("json", text)) == valid


@pytest.mark.parametrize("text", ["a = 1\n", "a.b = 'x'\n[t]\nc = [1, 2, # r\n 3]\n", "a = \n", "[t\n", "a = 1\na = 2\n", "[t]\n[t]\n", "[[t]]\nx = 1\n[[t]]\nx = 2\n", 'a = """x\ny"""\n', "a = {b = 1, c = [2]}\n", "a = 2024-13-01\n", "a = 01\n", "x", 'a = "x\n', "a = 1 b = 2\n", "", "a = 0x1F\nb = 1_000\nc = inf\n"])
def test_toml_like_the_library(text):
    try:
        tomllib.loads(text)
        valid = True
    except tomllib.TOMLDecodeError:
        valid = False
    assert (not syntax.check("toml", text)) == valid


@pytest.mark.parametrize("code", ["echo a\n", "if true; then\n echo\nfi\n", "if true; then\n", "for i in a b; do echo $i; done\n", "f() {\n  local x=\"$1\"\n  echo ${x:-a} | cat >> f\n}\n", "case $a in\n x|y) echo ;;\n *) ;;\nesac\n", "echo \"a\n", "while [ -z \"$a\" ]; do :; done\n", "a=$(cat <<E\nhi\nE\n)\n", "cat <<'E'\n$(\nE\n", "[[ $a == b && -n $c ]] || exit 1\n", "((i++))\n", "x=(a b)\n", "}\n", "fi\n", "echo $(\n", "<<<<<<< HEAD\nx\n=======\ny\n>>>>>>> b\n", "a | \n", "a && b || c &\n", "for ((i=0;i<3;i++)); do x; done\n", "echo 'it''s'\n", ""])
def test_bash_like_bash(code):
    ok = subprocess.run(["bash", "-n"], input=code.encode(), capture_output=True).returncode == 0
    assert (not syntax.check("bash", code)) == ok


GOOD_JS = ["export const f = async (a, { b = 1, ...c } = {}) => { await g`x${a}y`; };", "for (const x of y) { if (!x) continue; else break }", "class A extends B { #p = 1; static async *g() { yield* this.#p } get x() { return 1 } }", "const r = /a[/]b/g.test(s) ? x / y / z : {a, 'b': 1, [c]: 2, d() {}};", "import a, { b as c } from 'd';\nexport { c };\nexport default function () {}", "let a = 1\nlet b = 2\nlabel: while (1) { break label }", "try { a?.b?.[c]?.(d) } catch { } finally { }", "const f = function* () {}, g = x => ({ x });", "new Foo.Bar(1)(2).baz++;", "a ??= b ** c; x = 15.015 * .5e3 + 0x1fn;", "switch (a) { case 1: b(); default: c() }"]
BAD_JS = ["const a;", "let x = = 1;", "function f( { return 1 }", "if (a { b }", "const s = 'abc;", "const t = `a", "import logging", "def f(a):\n  pass", "<<<<<<< HEAD\n", "foo(a b);", "x = {a: 1", "return = 3", "class A { foo }}", "a => { ", "const x: number = 1;", "f() = 1;"]
GOOD_TS = ["export interface A<T extends B> { readonly x?: number[]; f(a: string): void; [k: string]: any }", "const f = (a: number, b?: string): Promise<Map<string, A>> => null as any;", "type U = 'a' | { b: C } | ((x: number) => void);", "enum E { A = 1, B }", "abstract class A implements B { private constructor(public x: number) { super(); } abstract f(): void; }", "declare module 'x' { export const y: number; }", "let v = <T,>(x: T) => x; let w = x!; const m = new Map<string, number>();", "function f(this: A, ...r: any[]): x is string { return true }"]


@pytest.mark.parametrize("code", GOOD_JS)
def test_valid_scripts(code):
    assert syntax.check("javascript", code) == [] and syntax.check("typescript", code) == []


@pytest.mark.parametrize("code", BAD_JS)
def test_invalid_scripts(code):
    assert syntax.check("javascript", code)


@pytest.mark.parametrize("code", GOOD_TS)
def test_typescript(code):
    assert syntax.check("typescript", code) == [] and syntax.check("javascript", code)


GOOD_YAML = ["a: 1\nb:\n  - x\n  - y: 2\n    z: [1, {q: w}]\n", "- a\n-\n  b: c\n", "k: |\n  text: : :\n   more\nl: >-\n  x\n", "'a b': \"x\\n\"\n# r\nc: d # e\n", "a:\n- b\n- c\n", "--- \na: 1\n...\n---\nb\n", "a: &x 1\nb: *x\n", "a: http://x.y/z\n", "a:\n  b\n  c\n", "", "plain text\n"]
BAD_YAML = ["a: b: c\n", "a: [1, 2\n", 'a: "x\n', "a:\n\tb: 1\n", "<<<<<<< HEAD\na: 1\n=======\n", "a: 1\n  b: 2\n", "a: 1\nb\n", "a: {x: 1\nb: 2\n", "- a\nb: c\n"]


@pytest.mark.parametrize("text", GOOD_YAML)
def test_valid_yaml(text):
    assert syntax.check("yaml", text) == []


@pytest.mark.parametrize("text", BAD_YAML)
def test_invalid_yaml(text):
    assert syntax.check("yaml", text)


def test_table(spark):
    rows = [("a", "p/x.py", "x = (", 1), ("b", "p\\y.PY", "x = 1", 1), ("c", None, "x", 1), ("d", "z.json", "", 1), ("e", "z.json", None, 1), ("f", "q.rs", "fn", 1)]
    df = spark.createDataFrame(rows, "node_id string, file string, code string, errors int")
    got = {r.node_id: r for r in sourcecheck.syntax_errors(df, "node_id", "file", "code").collect()}
    assert len(got["a"].errors) == 1 and got["b"].errors == [] and got["b"].language == "python"
    assert all(got[k].errors is None for k in "cdef")
    assert sourcecheck.syntax_errors(df.where("false"), "node_id", "file", "code").count() == 0
    assert {(r.language, r.files, r.invalid) for r in sourcecheck.acceptance(sourcecheck.syntax_errors(df, "node_id", "file", "code"), ["language"]).collect()} == {("python", 2, 1)}


def test_all_errors_are_kept_after_recovery():
    assert [e.line for e in syntax.check("python", "x = = 1\ny = 2\nz = )\n")] == [1, 3]
    assert len(syntax.check("javascript", "let a = = 1;\nconst b = 2;\nlet c = ;\nfunction f() {}\n")) == 2


@pytest.mark.parametrize(
    "language, text, lines",
    [
        ("json", '{"a": tru,\n "b": [1, , 2],\n "c": {"d" 1},\n "e": 3}', [1, 2, 3]),
        ("json", '[\n {"a": 1,},\n "x\ty, z",\n [1 2],\n 3\n]', [2, 3, 4]),
        ("json", '{"a": [1, 2}', [1]),
        ("yaml", "a: [1, 2\nb: 1\nc: x: y\nd:\n  e: @f\n  g: 2\nh: 'ok'\n", [1, 3, 5]),
        ("yaml", "- a: b: c\n  d: 1\n- %x\n- ok\n- \"open\n", [1, 3, 5]),
        ("bash", "echo (\nif true; then\n  a | ; b\n  c\nfi\nwhile x; do\n  if y; then z\ndone\n}\necho ok\n", [1, 3, 8, 9]),
        ("bash", "x=$(a |)\nfor in; do :; done\necho 'open\necho ok\n", [1, 3]),
    ],
)
def test_all_errors_are_listed(language, text, lines):
    assert [e.line for e in syntax.check(language, text)] == lines
