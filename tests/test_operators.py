"""Operators that SQL cannot say, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sievegrid.functions import text as T
from sievegrid.functions import vector as V
from sievegrid.operators import graph, records


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_pagerank_matches_a_plain_loop(spark):
    rng = random.Random(1)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(90)})
    pairs = [p for p in pairs if p[0] != p[1]]
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [d for s, d in pairs if s == n] for n in nodes}
    rank = {n: 1 / len(nodes) for n in nodes}
    for _ in range(60):
        loose = sum(rank[n] for n in nodes if not out[n])
        new = {n: 0.15 / len(nodes) + 0.85 * loose / len(nodes) for n in nodes}
        for n in nodes:
            for d in out[n]:
                new[d] += 0.85 * rank[n] / len(out[n])
        rank = new
    got = {r.node: r["rank"] for r in graph.pagerank(edges(spark, pairs), rounds=60, tolerance=1e-9).collect()}
    assert got.keys() == rank.keys()
    assert all(abs(got[n] - rank[n]) < 1e-6 for n in nodes)


def test_levels_and_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("y", "z")])
    assert {r.node: r.level for r in graph.levels(e).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "x": -1, "y": -1, "z": -1}
    assert {r.node for r in graph.cyclic(e).collect()} == {"x", "y"}
    assert {r.node: r.depth for r in graph.reach(e, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


@pytest.mark.parametrize("f", [graph.pagerank, graph.levels, graph.cyclic, graph.degrees])
def test_empty_graph(spark, f):
    assert f(edges(spark, [])).count() == 0


def test_systematic_takes_as_many_of_each(spark):
    df = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(1000)] + [(1000, None)], "id int, m string")
    got = {r.m: r["count"] for r in records.systematic(df, "m", "id").groupBy("m").count().collect()}
    assert got == {"a": 200, "b": 200}


def test_cap_leaves_others_alone(spark):
    df = spark.createDataFrame([(i, "x" if i < 80 else "y") for i in range(100)] + [(100, None)], "id int, m string")
    got = {r.m: r["count"] for r in records.cap_mode(df, "m", "x", "id", 0.5).groupBy("m").count().collect()}
    assert got == {"x": 10, "y": 20, None: 1}


def test_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(i, f"g{i % 37}" if i % 9 else None) for i in range(500)], "id int, g string")
    assert records.split_by_group(df, "g").groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_cosine_of_null_and_zero_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.8, 0.6]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.8, 0.0, 0.0]


def test_gates_take_nulls_and_blanks(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("Word " * 30,), ("x" * 200_000,)], "t string")
    t = F.col("t")
    rows = df.select(T.quality_reason(t).alias("q"), T.usable(t).alias("u"), T.token_estimate(t).alias("n"), T.byte_entropy(t).alias("e"), T.firewall(t).alias("f")).collect()
    assert [r.q for r in rows] == ["short_output", "short_output", "short_output", "missing_causal_structure", "short_output"]
    assert [r.u for r in rows] == [False, False, False, True, True]
    assert [r.n for r in rows] == [0, 0, 1, 38, 50000]
    assert rows[0].e is None and rows[1].e == 0.0


def test_redundant_pairs_match_brute_force(spark):
    import numpy as np

    from sievegrid.operators import similar

    rng = np.random.default_rng(3)
    base = rng.standard_normal((80, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + 0.12 * rng.standard_normal(base.shape), base[:5]]))] + [(900, None), (901, [0.0] * 16), (0, base[0].tolist())]
    df = spark.createDataFrame(rows, "k bigint, v array<double>")
    got = {(r.a, r.b) for r in similar.redundant_pairs(df, "k", "v").collect()}
    m = {k: np.array(v) for k, v in rows if v is not None and any(v)}
    cos = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    want = {(a, b) for a in m for b in m if a < b and cos(m[a], m[b]) >= 0.95}
    # Of equal vectors, links run from the least key.
    least = {k: min(j for j in m if (m[j] == m[k]).all()) for k in m}
    want = {(a, b) for a, b in want if least[a] == a and (least[b] == b or least[b] == a)}
    assert len(got ^ want) <= 0.02 * len(want) and len(want) > 60
    assert similar.redundant_pairs(df.where("false"), "k", "v").count() == 0


def test_deep_graphs_are_peeled_to_the_end(spark, monkeypatch):
    # Tables in memory: the rounds are many.
    monkeypatch.setattr(graph, "materialize", lambda df, name: spark.createDataFrame(df.toArrow()) if df.head(1) else spark.createDataFrame([], df.schema))
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(64)]
    assert {r.node: r.level for r in graph.levels(edges(spark, chain)).collect()} == {f"n{i:03}": i for i in range(65)}
    long = [(f"n{i:03}", f"n{i + 1:03}") for i in range(130)]
    assert {r.node for r in graph.cyclic(edges(spark, [*long, ("x", "y"), ("y", "x")])).collect()} == {"x", "y"}


def test_every_pair_of_near_vectors_and_their_copies(spark):
    import numpy as np

    from sievegrid.operators import similar

    rng = np.random.default_rng(4)
    base = rng.standard_normal((20, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + 0.05 * rng.standard_normal(base.shape), base[:4], base[:4]]))]
    df = spark.createDataFrame(rows, "k bigint, v array<double>")
    m = {k: np.array(v) for k, v in rows}
    want = {(a, b) for a in m for b in m if a < b and m[a] @ m[b] / np.linalg.norm(m[a]) / np.linalg.norm(m[b]) >= 0.95}
    assert {(r.a, r.b) for r in similar.every_pair(df, "k", "v").collect()} == want and len(want) > 30
    assert similar.bands_for(10, 0.95)[0] == 12 and similar.bands_for(1 << 30, 0.95)[0] == 28
