"""Slices of other languages, SQL lineage, reasoning vectors by syntax, payloads of policies, and a cache keyed by content."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLYGLOT = "key string, name string, kind string, first int, last int, calls array<string>"

#: How a function or class begins in languages with braces, and words that look like one.
HEAD = re.compile(r"(?:\b(?P<kind>class|interface|struct|trait|enum|impl)\s+(?P<type>[A-Za-z_$][\w$]*)[^;{}()]*|\b(?:function\s*\*?|fn|func|def)\s*(?P<fn>[A-Za-z_$][\w$]*)\s*(?:<[^>{}]*>)?\([^{};]*|\b(?P<method>[A-Za-z_$][\w$]*)\s*\([^(){};]*\)\s*(?:(?:throws|const|noexcept|->|:)[^{};=]*)?|\b(?:const|let|var)\s+(?P<arrow>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^(){};]*\)|[A-Za-z_$][\w$]*)\s*(?::[^{};=]*)?=>\s*)\{")
NO_NAME = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "match", "loop", "synchronized", "using", "lock", "foreach", "with", "super", "this"}
CALL = re.compile(r"\b([A-Za-z_$][\w$]*)\s*\(")
BLANKED = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")


def brace_slices(key: str, text: str) -> list[tuple]:
    """(key, name, kind, first, last, calls) of the functions and types of a text in a language with braces."""
    plain = BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    ends, stack = {}, []
    for i, c in enumerate(plain):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            ends[stack.pop()] = i
    out = []
    at = 0
    while m := HEAD.search(plain, at):
        at = m.start() + 1
        brace = m.end() - 1
        name = m["type"] or m["fn"] or m["arrow"] or m["method"]
        at = max(at, m.end("method") if m["method"] and m["method"] in NO_NAME else brace)
        if name in NO_NAME or brace not in ends:
            continue
        body = plain[brace : ends[brace]]
        kind = m["kind"] or "function"
        out.append((key, name, kind, text.count("\n", 0, m.start()) + 1, text.count("\n", 0, ends[brace]) + 1, sorted({c for c in CALL.findall(body)} - NO_NAME)))
    return out


def polyglot_slices(df: DataFrame, key: str, code: str) -> DataFrame:
    """One row per function and type of texts in languages with braces; null and empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for k, t in zip(b["key"], b["code"]) if t for r in brace_slices(k, t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in POLYGLOT.split(", ")]).astype({"first": "int32", "last": "int32"})

    return df.select(F.col(key).cast("string").alias("key"), F.col(code).alias("code")).mapInPandas(run, POLYGLOT)


def sql_tables(sql: Column) -> Column:
    """The tables that a statement reads or writes, sorted; names of its own WITH parts are none."""
    low = F.lower(F.regexp_replace(F.regexp_replace(sql, "--[^\\n]*", " "), "(?s)/\\*.*?\\*/", " "))
    named = F.regexp_extract_all(low, F.lit("\\b(?:from|join|into|update|table)\\s+([a-z_][a-z0-9_.]*)"), 1)
    own = F.regexp_extract_all(low, F.lit("(?:\\bwith\\s+(?:recursive\\s+)?|,\\s*)([a-z_][a-z0-9_]*)\\s+as\\s*\\("), 1)
    return F.array_sort(F.array_distinct(F.array_except(named, own)))


def sql_columns(sql: Column) -> Column:
    """The plain columns of a statement's first select list, sorted."""
    lists = F.regexp_extract(F.lower(sql), "(?s)\\bselect\\s+(?:distinct\\s+)?(.*?)\\bfrom\\b", 1)
    parts = F.transform(F.split(lists, ","), lambda x: F.regexp_extract(F.trim(x), "(?s)^(?:[a-z_][a-z0-9_]*\\.)?([a-z_][a-z0-9_]*)(?:\\s+as\\s+.*)?\\s*$", 1))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


VECTORS = "key string, intent string, strategy string, constraints array<string>, failure_modes array<string>, execution_pattern array<string>"


def reasoning_vectors(df: DataFrame, key: str, code: str) -> DataFrame:
    """Five vectors of Python texts by their syntax: what the docstring says, how it goes about it, what it asserts, what it
    catches, and its kinds of statements in order. Texts that do not parse have 'unknown' and empty lists."""

    def one(text):
        try:
            tree = ast.parse(text or "")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return "unknown", "unknown", [], [], []
        walk = list(ast.walk(tree))
        doc = ast.get_docstring(tree) or next((d for n in walk if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and (d := ast.get_docstring(n))), "")
        modules = {a.name.split(".")[0] for n in walk if isinstance(n, ast.Import) for a in n.names} | {(n.module or "").split(".")[0] for n in walk if isinstance(n, ast.ImportFrom)}
        waits = any(isinstance(n, (ast.AsyncFunctionDef, ast.Await)) for n in walk)
        strategy = "asynchronous" if waits else "delegating" if modules else "self_contained"
        asserts = [ast.unparse(n.test) for n in walk if isinstance(n, ast.Assert)]
        caught = sorted({ast.unparse(t) for n in walk if isinstance(n, ast.ExceptHandler) and n.type for t in (n.type.elts if isinstance(n.type, ast.Tuple) else [n.type])})
        pattern = []
        for n in walk:
            if isinstance(n, ast.stmt) and type(n).__name__.lower() not in pattern:
                pattern.append(type(n).__name__.lower())
        return doc.split("\n")[0] or "unknown", strategy, asserts, caught, pattern

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *one(t)) for k, t in zip(b["key"], b["code"])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in VECTORS.split(", ")])

    return df.select(F.col(key).cast("string").alias("key"), F.col(code).alias("code")).mapInPandas(run, VECTORS)


def policy_payloads(policies: DataFrame) -> DataFrame:
    """(path, theory, implementation) of policies (path, record as JSON): what they state and what they do, under any of the names
    that policies use; those without both come out with what they have."""
    g = lambda *keys: F.coalesce(*[F.get_json_object("record", f"$.{k}") for k in keys])
    theory = g("theory", "theory_text", "policy.description", "description", "rationale", "metadata.description")
    impl = g("implementation", "implementation_code", "policy.rules", "rules", "steps", "spec")
    return policies.select("path", theory.alias("theory"), impl.alias("implementation")).where("theory is not null or implementation is not null")


def cached(df: DataFrame, content: str, compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """What `compute` makes of (hash, content), kept in a table by the content's hash: only contents that it lacks are computed.

    compute gets one row per new content and must keep `hash`.
    """
    spark = df.sparkSession
    asked = df.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("hash"), F.col(content).alias("content")).dropDuplicates(["hash"])
    conf = spark._jsc.hadoopConfiguration()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(conf).exists(p):
        asked = asked.join(spark.read.parquet(path).select("hash").distinct(), "hash", "left_anti")
    compute(asked).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def passed(gates: DataFrame, flag: str = "passed") -> bool:
    """Whether every row of a gate's result holds; what a command would make its exit code of."""
    return gates.where(~F.coalesce(F.col(flag), F.lit(False))).isEmpty()
