import json

from pyspark.sql import functions as F

from sievegrid.operators import extract, formats
from sievegrid.sources import files


def test_json_lines_are_audited(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\nnot json\n[1]\n{"a": 2}\n')
    got = [(r.line_no, r.error) for r in files.json_lines_audit(spark, str(p)).orderBy("line_no").collect()]
    assert got == [(1, None), (2, "empty_line"), (3, "invalid_json"), (4, "row_not_object"), (5, None)]
    assert sorted(r.a for r in files.json_lines(spark, str(p), "a int").collect() if r.a is not None) == [1, 2]


def test_workspace_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.dat").write_bytes(b"\0\1\2" * 50)
    (tmp_path / "src" / "c.png").write_bytes(b"png")
    (tmp_path / "node_modules" / "d.js").write_text("let x;")
    got = {r.path.rsplit("/", 1)[1]: r.is_text for r in files.workspace(spark, str(tmp_path)).collect()}
    assert got == {"a.py": True, "b.dat": False}


NOTEBOOK = {
    "cells": [
        {"cell_type": "markdown", "source": ["# Why\n", "because of x"]},
        {"cell_type": "code", "source": "1/0", "outputs": [{"output_type": "error", "traceback": ["\x1b[31mZeroDivisionError\x1b[0m"]}], "execution_count": 1},
        {"cell_type": "markdown", "source": "zero was the cause"},
        {"cell_type": "code", "source": "1/1", "outputs": [], "execution_count": 2},
    ]
}


def test_notebooks(spark):
    df = spark.createDataFrame([("n", json.dumps(NOTEBOOK)), ("broken", "{"), ("none", None)], "path string, content string")
    cells = files.notebook_cells(df).cache()
    assert cells.where("cell_type = 'invalid'").count() == 2
    good = cells.where("path = 'n'")
    fix = extract.error_fixes(good).collect()
    assert [(r.error_cell, r.fix_cell, r.traceback) for r in fix] == [(1, 3, "ZeroDivisionError")]
    pairs = {r.cell_index: r.theory for r in extract.text_code_pairs(good).collect()}
    assert pairs == {1: "# Why\nbecause of x", 3: "zero was the cause"}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, v string")
    b = a.orderBy(F.desc("k")).repartition(3)
    assert files.fingerprint(a).first().digest == files.fingerprint(b).first().digest
    assert files.fingerprint(a).first().digest != files.fingerprint(a.distinct()).first().digest
    assert files.fingerprint(a.where("false")).first().rows == 0
    assert [r.line for r in files.canonical(a).collect()] == ['{"k":1,"v":"x"}', '{"k":2,"v":null}', '{"k":2,"v":null}']


def test_dual_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "bad")], "k int, why string")
    files.write_dual(df, "why", str(tmp_path / "out"))
    got = {(r.k, r.status) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {(1, "accepted"), (2, "rejected")}


def test_slices(spark):
    code = "class A:\n    '''d'''\n    def f(self, x: int):\n        y = g(x)\n        return y.h()\n\nasync def k():\n    pass\n"
    df = spark.createDataFrame([("a", code), ("b", "def ("), ("c", None), ("d", "")], "id string, code string")
    got = {(r.key, r.name): r for r in extract.python_slices(df, "id", "code").collect()}
    assert set(got) == {("a", "A"), ("a", "f"), ("a", "k")}
    f = got["a", "f"]
    assert f.calls == ["g", "h"] and f.assigned == ["y"] and f.typed == 0.5 and (f.first, f.last) == (3, 5)
    assert got["a", "A"].has_doc and got["a", "k"].kind == "coroutine"


def test_formats(spark):
    m = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo"), ("tool", "x"), ("assistant", " ")]), (2, [("user", "hi")]), (3, None), (4, [("system", "s"), ("user", "a"), ("assistant", "b")])], f"k int, m {m}")
    got = {r.k: r.c for r in df.select("k", formats.clean_messages(F.col("m"), "sys").alias("c")).collect()}
    assert [x.role for x in got[1]] == ["system", "user", "assistant"] and [x.train_loss for x in got[1]] == [False, False, True]
    assert got[2] is None and got[3] is None and len(got[4]) == 3
    b = spark.createDataFrame([(["reads the ledger first", "writes a new gateway"], ["x", "y"], ["when it is full of rows", "when nobody looks at it"]), (["same words here", "same words here"], ["x", "y"], ["c" * 20, "c" * 20]), (["one"], ["x"], ["c" * 20]), (["alpha beta", "gamma delta"], ["x", " "], ["c" * 20, "d" * 20])], "m array<string>, b array<string>, c array<string>")
    assert [r[0] for r in b.select(formats.branch_gate(F.col("m"), F.col("b"), F.col("c"))).collect()] == ["pass", "low_diversity", "insufficient_branches", "missing_failure_boundary"]
    t = spark.createDataFrame([("a <think>inner\nx</think> rest",)], "t string")
    assert tuple(t.select(*formats.think_parts(F.col("t"))).first()) == ("inner\nx", "rest")


def test_diff(spark):
    df = spark.createDataFrame([("a\nb", "a\nc"), ("x", "x"), (None, "x")], "a string, b string")
    got = [r[0] for r in df.select(extract.unified_diff("a", "b")).collect()]
    assert "-b" in got[0] and "+c" in got[0] and got[1] == "" and got[2] is None


def test_lines_are_numbered_across_the_splits_of_a_file(spark, tmp_path):
    from sievegrid.sources import files

    lines = [f'{{"k": {i}}}' if i % 7 else "" for i in range(5000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = {r.line_no: r.line for r in files.json_lines_audit(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == dict(enumerate(lines, 1))
