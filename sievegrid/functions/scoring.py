"""The numeric core as Column expressions: densities, alignment, confidence, decisions. Rounding is to four digits, halves up, by
the same arithmetic everywhere."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Scale of a mode, weights of the confidence, bands, tiers and penalties.
SCALE = {"theorist": 1.8, "coding_assistant": 1.0, "advocate": 0.9, "veteran": 1.1}
WEIGHTS = (0.4, 0.3, 0.2, 0.1)
ACCEPT, UNSTABLE, PRUNE = 0.40, 0.25, 0.35
DEPTH_RATE, DEPTH_CAP = 0.05, 0.3
CASCADE, COHERENCE, QUALITY_FLOOR = 0.5, 0.3, 0.1
BRANCH_STABLE, BRANCH_FACTOR = 0.4, 0.2
TIERS = {"collapse": 0.8, "reroll": 0.7, "warning": 0.6, "elevated": 0.3}
SENSITIVITY = 0.15
PENALTY = {"syntax": 0.5, "unsafe": 0.7, "sast": 0.85, "flattery": 0.4, "cosmetic": 0.95, "circular": 0.5}
PENALTY_FLOOR = 0.2


def r4(c: Column) -> Column:
    return F.floor(c * 10000 + 0.5) / 10000


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def alignment(assertions: Column, skill_type: Column, filled: Column) -> Column:
    """[coverage, novelty, consistency] of a node; nulls count as nothing."""
    a = F.least(F.lit(1.0), F.coalesce(assertions, F.lit(0)) / 5.0)
    b = F.when(skill_type.isin("validation", "theoretical_reasoning"), 0.7).otherwise(0.5)
    return F.array(a, b, F.coalesce(filled, F.lit(0)) / 5.0)


def filled(*parts: Column) -> Column:
    """How many of the parts are there and not empty."""
    total = F.lit(0)
    for p in parts:
        total = total + F.coalesce(p.cast("int"), F.lit(0))
    return total


def length(v: Column) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def quality(density: Column, v: Column, mode: str) -> Column:
    return r4(F.lit(SCALE.get(mode, 1.0)) * density * length(v))


def cosine3(a: Column, b: Column) -> Column:
    """Cosine of two alignment vectors; null where one is missing or nearly zero."""
    na, nb = length(a), length(b)
    return F.when((na >= 1e-9) & (nb >= 1e-9), (a[0] * b[0] + a[1] * b[1] + a[2] * b[2]) / (na * nb))


def slr(a: Column, b: Column) -> Column:
    """1 less the clipped cosine; 0 where a vector is missing or nearly zero."""
    return F.coalesce(r4(1.0 - clip(cosine3(a, b), 0.0, 1.0)), F.lit(0.0))


def floored_cosine(a: Column, b: Column, floor: float = SENSITIVITY) -> Column:
    """Cosine clipped to 0..1 whose norms are at least `floor`; null for vectors that are missing, empty or not finite."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.greatest(F.lit(floor), F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    bad = F.exists(F.concat(a, b), lambda x: F.isnan(x) | x.isNull())
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & ~bad, clip(dot / (norm(a) * norm(b)), 0.0, 1.0))


def topology(centrality: Column, calls: Column, satisfied: Column) -> Column:
    """The centrality from 0.1 on; else the satisfied share of the calls and one more, or 0.8 without calls."""
    c = F.least(F.lit(1.0), F.coalesce(centrality, F.lit(0.0)))
    return F.when(c >= 0.1, c).when(calls > 0, (F.coalesce(satisfied, F.lit(0)) + 1) / (calls + 1)).otherwise(0.8)


def evidence(source_type: Column, has_evidence: Column) -> Column:
    return F.when(F.lower(F.coalesce(source_type, F.lit(""))).isin("ast_code", "macro_skill"), 1.0).when(has_evidence, 0.85).otherwise(0.75)


def confidence(sie: Column, acs: Column, topo: Column, valid: Column, parent_slr: Column, depth: Column, drift: float = 0.0, pressure: float = 0.0) -> Column:
    """The weighted sum, then dampened by the parents' SLR, the identity's drift, the depth and the system's pressure."""
    one = lambda c: F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)))
    c = r4(F.least(F.lit(1.0), WEIGHTS[0] * one(sie) + WEIGHTS[1] * one(acs) + WEIGHTS[2] * topo + WEIGHTS[3] * valid))
    c = r4(c * (1.0 - F.coalesce(parent_slr, F.lit(0.0))))
    if drift:
        c = r4(c * (1.0 - min(1.0, drift)))
    c = r4(c * (1.0 - F.least(F.lit(DEPTH_CAP), F.coalesce(depth, F.lit(0)) * DEPTH_RATE)))
    if pressure:
        c = r4(c * (1.0 - min(pressure, 0.9)))
    return F.greatest(F.lit(0.0), c)


def cascade(c: Column, unaccepted: Column) -> Column:
    """Halved, and rounded, once per parent that is not accepted."""
    n = F.coalesce(unaccepted, F.lit(0)).cast("int")
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), c, lambda a, _: r4(a * CASCADE))).otherwise(c)


def decision(before: Column, after: Column, chain_ok: Column, budget: Column, trusted: bool = False) -> Column:
    """'STATE: reason' of a scored node. before and after are its confidence without and with the parents' cascade."""
    reroll = lambda why: F.when(F.coalesce(budget, F.lit(0)) > 0, f"REROLL: {why}").otherwise(f"REJECTED: budget_exhausted | {why}")
    accept = (
        F.when(~chain_ok, "REJECTED: parent_chain_failed")
        .when(after >= ACCEPT, "ACCEPTED: validated")
        .when(after >= UNSTABLE, reroll("soft_parent_cascade"))
        .otherwise("REJECTED: soft_parent_cascade_below_band")
    )
    band = F.lit("ACCEPTED: trusted_marginal_accept") if trusted else reroll("instability_band")
    return F.when(before >= ACCEPT, accept).when(before >= UNSTABLE, band).otherwise("REJECTED: below_instability_band")


def tier(s: Column) -> Column:
    out = F
    for name, least in TIERS.items():
        out = out.when(s >= least, name)
    return out.otherwise("safe")


def constraint_route(c: Column, severities: Column) -> Column:
    """0 if any constraint is fatal; else halved, and rounded, per error."""
    errors = F.size(F.filter(severities, lambda s: s == "error"))
    return F.when(F.exists(severities, lambda s: s == "fatal"), 0.0).otherwise(cascade(c, F.when(errors > 0, errors).otherwise(0)))


def penalised(c: Column, factor: Column, floor: float = PENALTY_FLOOR) -> Column:
    """Times the factor, but not under the floor from above it."""
    return F.when(c > floor, F.greatest(c * factor, F.lit(floor))).otherwise(c * factor)


def conflict(primary: Column, adverse: Column) -> Column:
    d = F.abs(primary - adverse)
    return F.when(d < 0.15, "agreement").when(d < 0.30, "minor_conflict").otherwise("major_conflict")


def trajectory(labels: Column, traceback: Column, diff: Column, resolved: Column) -> Column:
    """A row of four numbers and the response per step of a debugging loop, by the step's label."""
    has = [F.when(F.coalesce(F.length(c), F.lit(0)) > 0, 1.0).otherwise(0.0) for c in (traceback, diff, resolved)]
    zero, half, one = F.lit(0.0), F.lit(0.5), F.lit(1.0)

    def step(label: Column) -> Column:
        low = F.lower(label)
        row = F.when(low.isin("fix", "resolution", "resolved"), F.array(*has, one)).when(low.isin("error", "traceback", "failure"), F.array(has[0], zero, zero, zero)).when(low.isin("diagnosis", "analysis", "diagnostic"), F.array(has[0], zero, zero, half)).otherwise(F.array(zero, zero, zero, half))
        return F.struct(row.alias("row"), F.when(low.isin("fix", "resolution", "resolved"), 1.0).otherwise(0.0).alias("response"))

    return F.transform(labels, step)


@F.pandas_udf(DoubleType())
def ridge_slr(matrix: pd.Series, response: pd.Series) -> pd.Series:
    """1 less the clipped cosine of a ridge regression's weights and the response, the shorter filled with zeros; 0 for none."""
    import numpy as np

    def one(a, y):
        if a is None or y is None or not len(a) or not len(y):
            return 0.0
        a, y = np.array([np.asarray(r, float) for r in a]), np.asarray(y, float)
        if a.ndim != 2 or not a.size or np.isnan(a).any() or np.isnan(y).any():
            return 0.0
        w = np.linalg.solve(a.T @ a + SENSITIVITY * np.eye(a.shape[1]), a.T @ y)
        n = max(len(w), len(y))
        w, y = np.pad(w, (0, n - len(w))), np.pad(y, (0, n - len(y)))
        cos = w @ y / (max(np.linalg.norm(w), SENSITIVITY) * max(np.linalg.norm(y), SENSITIVITY))
        return round(1.0 - max(0.0, min(1.0, float(cos))), 4)

    return pd.Series([one(a, y) for a, y in zip(matrix, response)])


@F.pandas_udf(ArrayType(DoubleType()))
def code_measures(code: pd.Series) -> pd.Series:
    """[density, depth, docstring, share of functions with type hints] of Python code; all 0 where it does not parse."""

    def one(text):
        if not text:
            return [0.0] * 4
        try:
            tree = ast.parse(text)
        except (SyntaxError, RecursionError, ValueError, MemoryError):
            return [0.0] * 4
        depth, layer = 0, [tree]
        while depth < 20:
            layer = [c for n in layer for c in ast.iter_child_nodes(n)]
            if not layer:
                break
            depth += 1
        funcs = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        doc = float(any(ast.get_docstring(n) for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))))
        hints = sum(n.returns is not None or any(a.annotation for a in n.args.args) for n in funcs) / len(funcs) if funcs else 0.0
        return [min(1.0, depth / 10 + 0.2 * doc + 0.3 * hints), float(depth), doc, hints]

    return code.map(one)
