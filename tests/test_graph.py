"""Graph operators against plain Python on chains, rings, nests of cycles and random graphs."""

import random

import pytest

from sievegrid.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def reachable(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    got = {}
    for a in {x for e in edges for x in e}:
        seen, todo = set(), [a]
        while todo:
            for y in out.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        got[a] = seen
    return got


def strong(edges):
    r = reachable(edges)
    groups = {a: frozenset(b for b in r if b in r[a] and a in r[b]) | {a} for a in r}
    return {a: min(g) for a, g in groups.items() if len(g) > 1}


def longest(edges):
    out, indeg, level = {}, {}, {}
    for a, b in set(edges):
        out.setdefault(a, []).append(b)
        indeg[b] = indeg.get(b, 0) + 1
        level[a] = level[b] = -1
    todo = [a for a in level if not indeg.get(a)]
    best = {a: 0 for a in todo}
    while todo:
        a = todo.pop()
        level[a] = best[a]
        for b in out.get(a, ()):
            best[b] = max(best.get(b, 0), best[a] + 1)
            indeg[b] -= 1
            if not indeg[b]:
                todo.append(b)
    return level


def cases():
    rng = random.Random(3)
    ring = [(f"r{i:02}", f"r{(i + 1) % 12:02}") for i in range(12)]
    nest = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "f"), ("f", "g"), ("g", "f"), ("x", "a"), ("g", "y"), ("z", "z"), ("z", "y")]
    rand = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}") for _ in range(45)]
    dag = [(a, b) for a, b in ((f"d{rng.randrange(25):02}", f"d{rng.randrange(25):02}") for _ in range(60)) if a < b]
    return {"ring": ring, "nest": nest, "random": rand, "dag": dag, "ring with a tail": ring + [("r03", "t1"), ("t1", "t2"), ("s", "r05")], "one": [("p", "q")]}


@pytest.mark.parametrize("name", sorted(cases()))
def test_components_and_levels(spark, name):
    edges = cases()[name]
    df = frame(spark, edges)
    assert {r.node: r.component for r in graph.components(df).collect()} == strong(edges)
    assert {r.node for r in graph.cyclic(df).collect()} == set(strong(edges)) | {a for a, b in edges if a == b}
    no_loops = [(a, b) for a, b in edges if a != b]
    assert {r.node: r.level for r in graph.levels(df).collect()} == longest(no_loops)


def test_a_chain_of_ten_thousand(spark):
    n = 10_000
    df = frame(spark, [(f"c{i:05}", f"c{i + 1:05}") for i in range(n)])
    got = {r.node: r.level for r in graph.levels(df).collect()}
    assert got == {f"c{i:05}": i for i in range(n + 1)}
    assert graph.cyclic(df).count() == 0


def test_ranks(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")]
    nodes = sorted({x for e in edges for x in e})
    rank = {a: 1 / len(nodes) for a in nodes}
    deg = {a: sum(s == a for s, _ in edges) for a in nodes}
    for _ in range(300):
        loose = sum(r for a, r in rank.items() if not deg[a])
        rank = {a: 0.15 / 5 + 0.85 * (sum(rank[s] / deg[s] for s, t in edges if t == a) + loose / 5) for a in nodes}
    got = {r.node: r.rank for r in graph.pagerank(frame(spark, edges)).collect()}
    assert all(abs(got[a] - rank[a]) < 1e-7 for a in nodes)
    with pytest.raises(graph.NotConverged):
        graph.pagerank(frame(spark, edges), limit=3)
    assert graph.pagerank(frame(spark, edges).where("false")).count() == 0


def test_reach_without_a_depth(spark):
    df = frame(spark, [(f"c{i:02}", f"c{i + 1:02}") for i in range(12)] + [("c12", "c00")])
    got = {r.node: r.depth for r in graph.reach(df, spark.createDataFrame([("c03",)], "node string")).collect()}
    assert len(got) == 13 and got["c02"] == 12 and got["c03"] == 0


def test_empty_graph(spark):
    none = frame(spark, [("a", "b")]).where("false")
    assert graph.components(none).count() == 0 and graph.levels(none).count() == 0 and graph.triangles(none).count() == 0
