"""Extraction from code, notebooks and structured text."""

from __future__ import annotations

import ast
import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

SLICE = "key string, name string, kind string, first int, last int, calls array<string>, assigned array<string>, has_doc boolean, typed double, depth int"


def python_slices(df: DataFrame, key: str, code: str) -> DataFrame:
    """One row per function, coroutine and class of Python texts: lines, calls, assigned names, docstring, share of annotated parameters, depth.

    Texts that do not parse, null and empty ones give no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for k, t in zip(b["key"], b["code"]) if t for r in slices_of(k, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SLICE.split(", ")]).astype({"first": "int32", "last": "int32", "depth": "int32"})

    return df.select(F.col(key).cast("string").alias("key"), F.col(code).alias("code")).mapInPandas(run, SLICE)


def slices_of(key: str, text: str) -> list[tuple]:
    import warnings

    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out = []
    stack = [(n, 1) for n in ast.iter_child_nodes(tree)]
    while stack:
        node, depth = stack.pop()
        stack += [(n, depth + 1) for n in ast.iter_child_nodes(node)]
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        calls, names = set(), set()
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                f = n.func
                calls.add(f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else "")
            elif isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                names.add(n.id)
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if not isinstance(node, ast.ClassDef) else []
        kind = {"FunctionDef": "function", "AsyncFunctionDef": "coroutine", "ClassDef": "class"}[type(node).__name__]
        typed = sum(a.annotation is not None for a in args) / len(args) if args else 0.0
        out.append((key, node.name, kind, node.lineno, node.end_lineno, sorted(calls - {""}), sorted(names), ast.get_docstring(node) is not None, typed, depth))
    return sorted(out, key=lambda r: (r[3], r[1]))


def error_fixes(cells: DataFrame) -> DataFrame:
    """(path, error_cell, fix_cell, error_source, fix_source, traceback): the last failing code cell before a clean one, per notebook.

    Islands by a running count of clean code cells; a window is one notebook.
    """
    w = Window.partitionBy("path").orderBy("cell_index")
    code = cells.where("cell_type = 'code' and trim(source) <> ''").withColumn("ok", F.col("traceback").isNull())
    code = code.withColumn("g", F.sum(F.col("ok").cast("int")).over(w) - F.col("ok").cast("int"))
    bad = code.where("not ok").groupBy("path", "g").agg(F.max_by(F.struct("cell_index", "source", "traceback"), "cell_index").alias("e"))
    good = code.where("ok").select("path", "g", F.col("cell_index").alias("fix_cell"), F.col("source").alias("fix_source"))
    return bad.join(good, ["path", "g"]).select("path", F.col("e.cell_index").alias("error_cell"), "fix_cell", F.col("e.source").alias("error_source"), "fix_source", F.col("e.traceback").alias("traceback"))


def text_code_pairs(cells: DataFrame, least: float = 0.1) -> DataFrame:
    """(path, cell_index, theory, code, ratio): markdown since the last code cell with the code cell that follows it."""
    w = Window.partitionBy("path").orderBy("cell_index")
    filled = cells.where("trim(source) <> ''").withColumn("is_code", (F.col("cell_type") == "code").cast("int"))
    filled = filled.withColumn("g", F.sum("is_code").over(w) - F.col("is_code"))
    text = filled.where("cell_type = 'markdown'").groupBy("path", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cell_index", "source"))), lambda s: s["source"]), "\n").alias("theory"))
    code = filled.where("is_code = 1").select("path", "g", "cell_index", F.col("source").alias("code"))
    ratio = F.round(F.length("theory") / (F.length("theory") + F.length("code")), 3)
    return text.join(code, ["path", "g"]).withColumn("ratio", ratio).where(F.col("ratio") >= least).select("path", "cell_index", "theory", "code", "ratio")


@F.pandas_udf(StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Unified diff of two texts; empty where they are equal, null where one is null."""

    def one(x, y):
        if x is None or y is None:
            return None
        return "\n".join(difflib.unified_diff(x.splitlines(), y.splitlines(), "before", "after", lineterm=""))

    return pd.Series([one(x, y) for x, y in zip(a, b)])
